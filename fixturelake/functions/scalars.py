"""Scalar functions over odds, scores, names and dates, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that fold to plain ones in club names, and feed entities.
FOLD_FROM, FOLD_TO = "ıİşŞğĞçÇöÖüÜáàâäãéèêëíìîïóòôõúùûñ", "iissggccoouuaaaaaeeeeiiiioooouuun"
ENTITIES = {"&amp;": "&", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " "}
MONTHS = "January February March April May June July August September October November December".split()
OUTER_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def trim(c: Column) -> Column:
    """Without characters up to U+0020 at either end."""
    return F.regexp_replace(c, OUTER_BLANKS, "")


def parse_odds(c: Column) -> Column:
    """Odds text to a number, 0.0 where it has none; a decimal comma is allowed (F1)."""
    return F.coalesce(F.translate(trim(c), ",", ".").try_cast("double"), F.lit(0.0))


def known_odds(c: Column) -> Column:
    """A stored 0.0 and null both mean that the odds are missing."""
    return F.coalesce(c, F.lit(0.0))


def parse_score(c: Column) -> Column:
    """struct(home, away) of ``h-a``; null unless both parts are whole numbers (F2)."""
    parts = F.split(c, "-", 2)
    home, away = trim(F.get(parts, F.lit(0))).try_cast("int"), trim(F.get(parts, F.lit(1))).try_cast("int")
    return F.when(home.isNotNull() & away.isNotNull(), F.struct(home.alias("home"), away.alias("away")))


def side(home: Column, away: Column) -> Column:
    """1, X or 2; ? for an unknown score."""
    return F.when(home > away, "1").when(home < away, "2").when(home == away, "X").otherwise("?")


def htft_label(ht_home: Column, ht_away: Column, ft_home: Column, ft_away: Column) -> Column:
    """Half-time and full-time side, as in 1/X; ?/? if either is unknown."""
    known = ht_home.isNotNull() & ht_away.isNotNull() & ft_home.isNotNull() & ft_away.isNotNull()
    return F.when(known, F.concat_ws("/", side(ht_home, ht_away), side(ft_home, ft_away))).otherwise("?/?")


def comeback(ht_home: Column, ht_away: Column, ft_home: Column, ft_away: Column) -> Column:
    """1/2 or 2/1 where the half-time lead was overturned, else null."""
    return F.when((ht_home > ht_away) & (ft_home < ft_away), "1/2").when((ht_home < ht_away) & (ft_home > ft_away), "2/1")


def comeback_text(ft: Column, ht: Column) -> Column:
    """The same for score texts; anything but digits and hyphens is dropped first."""
    f, h = (parse_score(F.regexp_replace(c, r"[^0-9-]", "")) for c in (ft, ht))
    return comeback(h["home"], h["away"], f["home"], f["away"])


def normalize_score(c: Column) -> Column:
    """Smaller goals first; unreadable text unchanged."""
    s = parse_score(c)
    return F.when(s.isNotNull(), F.concat_ws("-", F.least(s["home"], s["away"]), F.greatest(s["home"], s["away"]))).otherwise(c)


def scores_equivalent(a: Column, b: Column) -> Column:
    """Equal or mirrored, blanks aside."""
    a, b = F.replace(a, F.lit(" ")), F.replace(b, F.lit(" "))
    return normalize_score(a) == normalize_score(b)


def reverse_score(c: Column) -> Column:
    """``2-1`` as ``1-2``."""
    return F.array_join(F.reverse(F.split(c, "-")), "-")


def score_in(c: Column, *accepted: str) -> Column:
    """Whether the score, blanks aside, is one of the accepted (F8)."""
    return F.replace(c, F.lit(" ")).isin(*accepted)


def normalize_name(c: Column) -> Column:
    """Folded, lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.translate(c, FOLD_FROM, FOLD_TO)), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    """Parts of a name between blanks, without characters other than ASCII letters and digits, lower case."""
    parts = F.transform(F.split(trim(c), r"\s+"), lambda x: F.lower(F.regexp_replace(x, "[^A-Za-z0-9]", "")))
    return F.filter(parts, lambda x: x != "")


def teams_match(a: Column, b: Column) -> Column:
    """Names of one club: equal or containing after folding, a shared token of three, or a token that begins another with four."""
    na, nb = normalize_name(a), normalize_name(b)
    ta, tb = tokens(a), tokens(b)
    shared = F.exists(ta, lambda x: (F.length(x) >= 3) & F.array_contains(tb, x))
    begins = F.exists(
        ta,
        lambda x: F.exists(tb, lambda y: (F.least(F.length(x), F.length(y)) >= 4) & (F.startswith(x, y) | F.startswith(y, x))),
    )
    named = (F.length(na) > 0) & (F.length(nb) > 0)
    return F.coalesce(named & ((na == nb) | F.contains(na, nb) | F.contains(nb, na) | shared | begins), F.lit(False))


def opponent_of(home: Column, away: Column, team: Column, fuzzy: bool = False) -> Column:
    """The other club of a match; by similar names, both clubs where neither is the team."""
    if not fuzzy:
        return F.when(home == team, away).otherwise(home)
    return F.when(teams_match(home, team), away).when(teams_match(away, team), home).otherwise(F.concat_ws("/", home, away))


def window_label(day: Column) -> Column:
    """First week of a month, last week, or mid."""
    return F.when(day.between(1, 7), "1-7").when(day.between(24, 31), "24-31").otherwise("mid")


def winner(home: Column, away: Column) -> Column:
    """HOME, AWAY, DRAW, or PENDING without a score."""
    return F.when(home > away, "HOME").when(home < away, "AWAY").when(home == away, "DRAW").otherwise("PENDING")


def score_text(home: Column, away: Column) -> Column:
    """``h - a``, or ``-`` without a score."""
    return F.when(home.isNotNull() & away.isNotNull(), F.concat_ws(" - ", home, away)).otherwise("-")


def local_time(seconds: Column, zone: str = "Europe/London") -> Column:
    """Epoch seconds as day and minute in a zone; the session's zone is UTC."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), "dd.MM.yyyy HH:mm"), F.lit("N/A"))


def odds_text(c: Column) -> Column:
    """Two decimals, or ``-``."""
    return F.when(c.isNotNull(), F.format_string("%.2f", c)).otherwise("-")


def result_flags(result: Column, over_under: Column, both_score: Column, place: Column) -> Column:
    """Flags of the short result texts of a match; false for null."""
    over = F.contains(over_under, F.lit("U")) | F.contains(over_under, F.lit("Ü"))
    flags = {
        "win": result == "G", "loss": result == "M", "draw": result == "B", "over": over, "under": F.contains(over_under, F.lit("A")) & ~F.contains(over_under, F.lit("U")),
        "both_scored": both_score == "KG", "home": place == "home", "away": place == "away",
    }
    return F.struct(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where some were cut; ``-`` for null (F16)."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(F.coalesce(c, F.lit("-")))


def label_key(c: Column, fixed: dict[str, str]) -> Column:
    """A label's key: a fixed one, else lower case with underscores for blanks and slashes."""
    plain = F.regexp_replace(F.lower(trim(c)), "[ /]", "_")
    if not fixed:
        return plain
    table = F.create_map(*[F.lit(x) for kv in sorted(fixed.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, trim(c)), plain)


def clean_text(c: Column) -> Column:
    """Without tags and outer blanks, entities decoded."""
    bare = F.regexp_replace(c, "<[^>]*>", "")
    return trim(reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), bare))


def year_label(c: Column) -> Column:
    """The season in a title or address, ``2024/2025`` and ``2024-2025`` alike, else a single year."""
    pair = F.regexp_extract(c, r"((?:19|20)\d{2}[/-](?:19|20)\d{2})", 1)
    year = F.regexp_extract(c, r"((?:19|20)\d{2})", 1)
    return F.when(pair != "", F.replace(pair, F.lit("/"), F.lit("-"))).when(year != "", year)


def month_name(month: Column) -> Column:
    """The name of a month's number."""
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), month - 1)


def participant_key(participant: Column, home_id: Column, without: str, home: str, other: str) -> Column:
    """Outcome by participant: none, the home side, or any other."""
    return F.when(participant.isNull(), without).when(participant == home_id, home).otherwise(other)


def scope_label(c: Column) -> Column:
    """Period of a betting scope; null for others."""
    return F.when(c == "FULL_TIME", "Full Time").when(c == "FIRST_HALF", "1st Half").when(c == "SECOND_HALF", "2nd Half")
