"""Scalar functions against literal inputs, malformed ones included."""

import pytest
from pyspark.sql import functions as F

from fixturelake.functions import scalars as S
from fixturelake.functions.catalogue import odds_columns, resolve_columns

L = F.lit
CASES = [
    (lambda: S.parse_odds(L("1,85")), 1.85), (lambda: S.parse_odds(L("-")), 0.0), (lambda: S.parse_odds(L("")), 0.0), (lambda: S.parse_odds(L(None).cast("string")), 0.0), (lambda: S.parse_odds(L("x")), 0.0),
    (lambda: S.normalize_score(L("2-1")), "1-2"), (lambda: S.normalize_score(L("abc")), "abc"), (lambda: S.normalize_score(L("2-")), "2-"),
    (lambda: S.parse_score(L("2-")), None), (lambda: S.parse_score(L(" 2 - 1"))["away"], 1), (lambda: S.reverse_score(L("2-1")), "1-2"),
    (lambda: S.comeback_text(L("1-2"), L("1-0")), "1/2"), (lambda: S.comeback_text(L("2-1"), L("0-1")), "2/1"), (lambda: S.comeback_text(L("2-1"), L("0-0")), None), (lambda: S.comeback_text(L("x"), L("0-1")), None),
    (lambda: S.teams_match(L("Atl."), L("Atletico")), True), (lambda: S.teams_match(L("P.Warszawa U19"), L("Polonia Warszawa U19")), True), (lambda: S.teams_match(L("X U19"), L("Y U19")), True),
    (lambda: S.teams_match(L("S.Bratislava"), L("Slovan Bratislava")), False), (lambda: S.teams_match(L(""), L("A")), False), (lambda: S.teams_match(L(None).cast("string"), L("A")), False),
    (lambda: S.window_label(L(1)), "1-7"), (lambda: S.window_label(L(8)), "mid"), (lambda: S.window_label(L(31)), "24-31"),
    (lambda: S.htft_label(L(None).cast("int"), L(1), L(1), L(1)), "?/?"), (lambda: S.htft_label(L(1), L(0), L(1), L(1)), "1/X"), (lambda: S.side(L(0), L(1)), "2"),
    (lambda: S.scores_equivalent(L("2 - 1"), L("1-2")), True), (lambda: S.score_in(L("1 - 0"), "1-0", "0-1"), True), (lambda: S.truncate(L("abcdef"), 4), "abc…"), (lambda: S.truncate(L(None).cast("string"), 4), "-"),
    (lambda: S.clean_text(L(" <b>A &amp; B</b> ")), "A & B"), (lambda: S.year_label(L("/x/2024/2025/")), "2024-2025"), (lambda: S.year_label(L("cup-2024")), "2024"), (lambda: S.year_label(L("none")), None),
    (lambda: S.month_name(L(5)), "May"), (lambda: S.odds_text(L(1.5)), "1.50"), (lambda: S.odds_text(L(None).cast("double")), "-"), (lambda: S.local_time(L(1720000000)), "03.07.2024 10:46"), (lambda: S.local_time(L(None).cast("long")), "N/A"),
    (lambda: S.opponent_of(L("Aaaa"), L("Bbbb"), L("Aaaa FC"), True), "Bbbb"), (lambda: S.opponent_of(L("Aaaa"), L("Bbbb"), L("Bbbb"), True), "Aaaa"), (lambda: S.opponent_of(L("Aaaa"), L("Bbbb"), L("Cccc"), True), "Aaaa/Bbbb"), (lambda: S.opponent_of(L("A"), L("B"), L("B")), "A"),
    (lambda: S.result_flags(L("G"), L("2.5 Ü"), L("KG"), L("home")), (True, False, False, True, False, True, True, False)), (lambda: S.result_flags(L("B"), L("AU"), L(None).cast("string"), L("away")), (False, False, True, True, False, False, False, True)), (lambda: S.result_flags(L("M"), L("A"), L("YOK"), L(None).cast("string")), (False, True, False, False, True, False, False, False)),
    (lambda: S.winner(L(None).cast("int"), L(1)), "PENDING"), (lambda: S.normalize_name(L("Beşiktaş J.K.")), "besiktasjk"), (lambda: F.array_join(S.tokens(L("Beşiktaş J.K.")), " "), "beikta jk"), (lambda: S.label_key(L(" Engine size "), {"Year": "y"}), "engine_size"),
]


def test_literals(spark):
    row = spark.range(1).select(*[f().alias(f"c{k}") for k, (f, _) in enumerate(CASES)]).first()
    wrong = [(k, row[k], want) for k, (_, want) in enumerate(CASES) if row[k] != want]
    assert not wrong


def test_season_columns(spark):
    from fixturelake.sources.feeds import season_range, seasons_back

    labels = ["2025-2026", "2025/26", "2026", "2000/00"]
    row = spark.range(1).select(*[seasons_back(L(x), 4) for x in labels]).first()
    assert [list(x) for x in row] == [season_range(x, 4) for x in labels]


def test_catalogue():
    names = [c["name"] for c in odds_columns()]
    assert len(names) == len(set(names)) == 100
    assert names[0] == "ft_1_a" and names[-1] == "ft_score_2_5_a"
    assert resolve_columns(["1x2|Full Time|Draw", "none"]) == (["ft_x_a"], ["none"])


@pytest.mark.parametrize(("label", "want"), [("2025-2026", "2024-2025"), ("2025/26", "2024/25"), ("2026", "2025"), ("2000/00", "1999/99")])
def test_season_range(label, want):
    from fixturelake.sources.feeds import season_range

    assert season_range(label, 2) == [label, want]
