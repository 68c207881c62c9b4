"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Raking scales the cells' token weights
to one marginal after the other, ROUNDS times, so that tokens times weight add up to each
marginal's targets.  Targets are given, or made from the data as tokens to the power of a
temperature (1: as found, 0: all alike).  Sampling probabilities are the weights times one factor, at
most 1, the factor being such that the expected number of tokens kept is ``keep`` of all.  A
document is kept if a number in [0, 1) made from its id is below its probability.

Only the table of cells is raked: it is as large as the numbers of sources, languages and topics
that occur together.  Up to MAX_CELLS cells are raked as numpy arrays on the driver; more stay a
DataFrame, by the same steps.

Defined results: null values of a dimension are the value ``(none)``; null texts have no
tokens; cells without tokens keep weight 1 until a marginal scales them; a value without a
target keeps its tokens' share out (weight 0); repeated rows are treated alike and kept; a null id
counts as an empty one; an empty table gives no rows; clashing columns are not carried over."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import table, written

ROUNDS, FACTOR_ROUNDS, MAX_CELLS = 24, 10, 1 << 18
NONE = "(none)"
DIMS = ["source", "lang", "topic"]
#: Of the query: temperatures, and the share of all tokens to keep.
TEMPERATURES, KEEP = {"source": 0.5, "lang": 0.7, "topic": 0.8}, 0.6
WORD = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def topic(text: Column) -> Column:
    """A plain topic by marks in the text; pass another column to :func:`mix` for a better one."""
    return (
        F.when(F.coalesce(F.btrim(text), F.lit("")) == "", "empty")
        .when(F.instr(text, "icense") > 0, "legal")
        .when(F.instr(text, " | ") > 0, "table")
        .when(F.instr(text, "!!") > 0, "shout")
        .when(F.instr(text, "http") > 0, "web")
        .otherwise("prose")
    )


def unit(id_: Column) -> Column:
    """A number in [0, 1) made from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets_of(cells: DataFrame, dim: str, temperature: float) -> DataFrame:
    """(value, target): tokens to the power of the temperature, as shares of all."""
    by = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").withColumn("t", F.pow("tokens", F.lit(temperature)))
    total = by.agg(F.sum("t")).first()[0] or 1.0
    return by.select("value", (F.col("t") / total).alias("target"))


def _raked(cells, targets: dict, keep: float):
    """pandas cells with weight and probability."""
    m = cells["tokens"].to_numpy(dtype=np.float64)
    total = m.sum()
    codes, want = {}, {}
    for d in DIMS:
        code, values = cells[d].factorize()
        codes[d], want[d] = code, np.array([targets[d].get(v, 0.0) for v in values]) * total
    w = np.ones(len(cells))
    for _ in range(ROUNDS):
        for d in DIMS:
            now = np.bincount(codes[d], m * w, len(want[d]))
            w = w * np.where(now > 0, want[d] / np.where(now > 0, now, 1), 1.0)[codes[d]]
    factor = keep * total / max((m * w).sum(), 1e-300)
    for _ in range(FACTOR_ROUNDS):
        full = factor * w >= 1
        rest = (m * w)[~full].sum()
        if rest > 0:
            factor = (keep * total - m[full].sum()) / rest
    return cells.assign(weight=w, probability=np.minimum(1.0, factor * w))


def _raked_frame(cells: DataFrame, targets: dict[str, DataFrame], keep: float) -> DataFrame:
    """The same steps over a table of cells too large for the driver."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    rows = cells.withColumn("weight", F.lit(1.0))
    for d in DIMS:
        rows = rows.join(targets[d].select(F.col("value").alias(d), (F.col("target") * total).alias(f"_want_{d}")), d, "left").fillna(0.0, [f"_want_{d}"])
    for _ in range(ROUNDS):
        for d in DIMS:
            sums = rows.groupBy(d).agg(F.sum(F.col("tokens") * F.col("weight")).alias("_now"))
            scaled = F.when(F.col("_now") > 0, F.col("weight") * F.col(f"_want_{d}") / F.col("_now")).otherwise(F.col("weight"))
            rows = rows.join(sums, d).withColumn("weight", scaled).drop("_now")
        rows = written(rows, "raking")
    mass = F.col("tokens") * F.col("weight")
    factor = keep * total / max(rows.agg(F.sum(mass)).first()[0] or 0.0, 1e-300)
    for _ in range(FACTOR_ROUNDS):
        full = F.col("weight") * factor >= 1
        got = rows.agg(F.sum(F.when(~full, mass)).alias("rest"), F.sum(F.when(full, F.col("tokens"))).alias("full")).first()
        if got["rest"]:
            factor = (keep * total - (got["full"] or 0.0)) / got["rest"]
    return rows.select(*DIMS, "tokens", "weight", F.least(F.lit(1.0), F.col("weight") * factor).alias("probability"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float, max_cells: int = MAX_CELLS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with their weight and sampling probability.

    The cells are read several times: pass a table."""
    if cells.count() > max_cells:
        return _raked_frame(cells, targets, keep)
    # Only the targets of values that there are: at most max_cells.
    at = {d: {r["value"]: r["target"] for r in targets[d].join(cells.select(F.col(d).alias("value")), "value", "left_semi").collect()} for d in DIMS}
    pdf = cells.toPandas().sort_values(DIMS, ignore_index=True)
    schema = "source string, lang string, topic string, tokens double, weight double, probability double"
    return F.broadcast(cells.sparkSession.createDataFrame(_raked(pdf, at, keep), schema))  # max_cells rows at most


def _drawn(docs: DataFrame, temperatures: dict[str, float] | None, keep: float, targets: dict[str, DataFrame] | None, id_col: str, text_col: str, topic_of: Column | None, more: list[Column]) -> DataFrame:
    """(_id, source, lang, topic, n_tokens, weight, probability, kept) of each row, and ``more``."""
    text = F.col(text_col)
    own = [
        F.col(id_col).alias("_id"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        F.coalesce(topic(text) if topic_of is None else topic_of, F.lit(NONE)).alias("topic"),
        n_tokens(text).alias("n_tokens"),
    ]
    cells = written(docs.select(*own).groupBy(*DIMS).agg(F.sum("n_tokens").cast("double").alias("tokens")), "cells")
    temperatures = temperatures or TEMPERATURES
    targets = {d: (targets or {}).get(d) or targets_of(cells, d, temperatures[d]) for d in DIMS}
    raked = rake(cells, targets, keep).drop("tokens")
    out = docs.select(*own, *more).join(raked, DIMS)
    probability = F.round("probability", 6)
    return out.withColumns({"weight": F.round("weight", 6), "probability": probability, "kept": unit(F.col("_id")) < probability})


def mix(docs: DataFrame, temperatures: dict[str, float] | None = None, keep: float = KEEP, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """(id, source, lang, topic, n_tokens, weight, probability, kept) of each row.

    targets: by dimension, frames (value, target share); else made by ``temperatures``."""
    out = _drawn(docs, temperatures, keep, targets, id_col, text_col, topic_of, [])
    return out.select(F.col("_id").alias(id_col), *DIMS, "n_tokens", "weight", "probability", "kept")


def sample(docs: DataFrame, temperatures: dict[str, float] | None = None, keep: float = KEEP, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", topic_of: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` keeps, with all their columns; each row is decided by itself."""
    out = _drawn(docs, temperatures, keep, targets, id_col, text_col, topic_of, [F.struct(*docs.columns).alias("_row")])
    return out.where("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql() -> str:
    parts = [
        rf"""docs AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN contains(text, 'icense') THEN 'legal' WHEN contains(text, ' | ') THEN 'table'
       WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, 'http') THEN 'web' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS n_tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS m FROM docs GROUP BY ALL)",
        "total AS (SELECT sum(m) AS t FROM cells)",
    ]
    for d in DIMS:
        parts.append(f"want_{d} AS (SELECT {d}, t0 / sum(t0) OVER () * (SELECT t FROM total) AS want FROM (SELECT {d}, pow(sum(m), {TEMPERATURES[d]}) AS t0 FROM cells GROUP BY 1 HAVING sum(m) > 0))")
    parts.append("w0 AS (SELECT *, 1.0::DOUBLE AS w FROM cells)")
    n = 0
    for _ in range(ROUNDS):
        for d in DIMS:
            parts.append(
                f"w{n + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, m, CASE WHEN sum(m * w) OVER (PARTITION BY c.{d}) > 0 THEN w * coalesce(want, 0) / sum(m * w) OVER (PARTITION BY c.{d}) ELSE w END AS w FROM w{n} c LEFT JOIN want_{d} USING ({d}))"
            )
            n += 1
    parts.append(f"k0 AS (SELECT {KEEP} * (SELECT t FROM total) / sum(m * w) AS k FROM w{n})")
    for i in range(FACTOR_ROUNDS):
        parts.append(
            f"k{i + 1} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN k * w < 1 THEN m * w END) > 0 THEN ({KEEP} * (SELECT t FROM total) - coalesce(sum(CASE WHEN k * w >= 1 THEN m END), 0)) / sum(CASE WHEN k * w < 1 THEN m * w END) ELSE max(k) END AS k FROM w{n}, k{i})"
        )
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, round(w, 6) AS weight, round(least(1.0, k * w), 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0::DOUBLE < round(least(1.0, k * w), 6) AS kept
FROM docs JOIN w{n} USING (source, lang, topic), k{FACTOR_ROUNDS}"""
    )


SQL = _sql()
