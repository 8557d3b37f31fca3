"""Writing: history appends, wide reports and exports of related tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixturelake.functions.scalars import local_time, odds_text, score_text, winner
from fixturelake.operators.history import with_odds


def write_history(df: DataFrame, odds: list[str], path: str | None = None, jdbc: dict[str, str] | None = None, batch: int = 1000) -> None:
    """Append matches that have odds to a Parquet folder or a JDBC table, in batches of a commit (S3)."""
    rows = with_odds(df, odds)
    if jdbc:
        rows.write.format("jdbc").options(batchsize=str(batch), **jdbc).mode("append").save()
    else:
        rows.write.mode("append").parquet(path)


def match_report(matches: DataFrame, odds: DataFrame, key: str = "match_id") -> DataFrame:
    """Matches with score, winner, local time and odds texts."""
    joined = matches.join(odds, key, "left")
    texts = {f"{c}_text": odds_text(F.col(c)) for c in ("odd_home", "odd_draw", "odd_away") if c in joined.columns}
    return joined.withColumns({"score": score_text(F.col("home_score"), F.col("away_score")), "winner": winner(F.col("home_score"), F.col("away_score")), "local": local_time(F.col("started")), **texts})


def export_relations(frames: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Each table in a folder of its name."""
    for name, df in frames.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")
