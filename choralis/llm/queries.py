"""The operators as queries over the tables of a folder."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choralis.llm import common

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """The content of a public vocabulary file, read on the driver."""
    if folder:
        path = f"{folder}/{name}"
    else:
        path = importlib.import_module("public_tokenizers").path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.minhash import near_classes

    return near_classes(common.documents(spark, sf_dir)).select("doc_id", "class_id", F.col("root").alias("class_root"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.bpe import token_digests

    return token_digests(common.documents(spark, sf_dir), vocabulary())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.toxicity import learn_toxicity, score_toxicity

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    seen = common.crc_mod(F.col("doc_id"), 3) != 1
    model = learn_toxicity(docs.where(seen), labels(spark, sf_dir))
    scored = score_toxicity(docs, model).withColumn("held_out", ~seen)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.quality import judge_quality, learn_references

    docs = common.documents(spark, sf_dir)
    return judge_quality(docs, learn_references(docs.select("text", "lang")))


def op5_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.ngrams import learn_ngrams, score_ngrams

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = common.crc_mod(F.col("doc_id"), 10) == 0
    scored = score_ngrams(docs, learn_ngrams(docs.where(~out).select("text")))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.mixing import mixed_sizes

    return mixed_sizes(common.documents(spark, sf_dir).select("doc_id", "text", "source"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.lines import dedup_lines

    docs = common.documents(spark, sf_dir)
    out = dedup_lines(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "n_removed", "emptied", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.language import learn_languages, predict_languages

    docs = common.documents(spark, sf_dir)
    seen = common.crc_mod(F.col("doc_id"), 3) != 1
    model = learn_languages(docs.where(seen).select("text", "lang"))
    out = predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (~seen).alias("held_out"), "lang_pred", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.topk import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.private import KINDS, find_private, joined

    found = find_private(common.documents(spark, sf_dir).select("doc_id", "text"), support=2, coarse=True)

    def count(kind: str, spans: str = "spans") -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.concat("spans", "extra", "terms")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"),
        *(count(k, "extra") for k in ("secret", "number")), F.size("terms").cast("long").alias("n_term"), F.size(every).cast("long").alias("n_spans"),
    )


def op11_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.funnels import Funnel, count_funnels

    funnels = [
        Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
        Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
        Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
    ]
    return count_funnels(spark.read.parquet(f"{sf_dir}/clicks.parquet"), funnels)


def op12_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.discriminant import document_statistics, learn_discriminant, score_quality

    stats = common.written(document_statistics(common.documents(spark, sf_dir)), "quality-statistics")
    seen = common.crc_mod(F.col("doc_id"), 3) != 1
    scored = score_quality(stats, learn_discriminant(stats.where(seen), labels(spark, sf_dir)))
    return scored.select("doc_id", (~seen).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from choralis.llm.ranked import build_index, search, written_index

    index = written_index(build_index(common.documents(spark, sf_dir)))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


OP7_SQL = r"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
l AS (
  SELECT r, doc_id, coalesce('s' || source, 'none') AS site, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
b AS (SELECT k, min((r, pos)) AS f FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 3),
m AS (SELECT l.*, b.k IS NOT NULL AND (l.r, l.pos) <> b.f AS gone FROM l LEFT JOIN b ON l.k = b.k),
t AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)) AS text FROM m GROUP BY r)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_removed, 0) > 0 AND regexp_replace(coalesce(t.text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') = '' AS emptied,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(t.text, '')) END AS text_sha256
FROM d LEFT JOIN t USING (r)
"""


OP9_SQL = """
WITH r AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 20
"""


def _op11_sql() -> str:
    def step(funnel: str, n: int, kind: str, then: str, stop: str) -> str:
        """Attempts of a funnel that stand at step n, and the time of the next where it is reached."""
        return f"""SELECT p.funnel, p.client_id, x.us, CASE WHEN n_{then} - x.us <= 900000000 AND (n_{stop} IS NULL OR n_{stop} > n_{then}) THEN n_{then} END AS "next"
      FROM p{n - 1} p JOIN w x ON x.client_id = p.client_id AND x.us = p."next" AND x.kind = '{kind}' WHERE p.funnel = '{funnel}'"""

    funnels = {"A": ("view", "click", "view", "purchase", "error"), "B": ("signup", "view", "click", "purchase", "error"), "C": ("click", "click", "purchase", "view", "signup")}
    kinds = ("view", "click", "purchase", "signup", "error")
    nexts = ", ".join(f"min(us) FILTER (kind = '{k}') OVER later AS n_{k}" for k in kinds)
    first = " UNION ALL ".join(
        f"""SELECT '{f}' AS funnel, client_id, us, CASE WHEN n_{s[1]} - us <= 900000000 AND (n_{s[4]} IS NULL OR n_{s[4]} > n_{s[1]}) THEN n_{s[1]} END AS "next" FROM w WHERE kind = '{s[0]}'"""
        for f, s in funnels.items()
    )
    second = " UNION ALL ".join(step(f, 2, s[1], s[2], s[4]) for f, s in funnels.items())
    third = " UNION ALL ".join(step(f, 3, s[2], s[3], s[4]) for f, s in funnels.items())

    def counts(n: int) -> str:
        return f"""c{n} AS (SELECT funnel, client_id, count(*) AS n, count("next") AS m, list_sort(list("next" - us) FILTER ("next" IS NOT NULL)) AS ts FROM p{n} GROUP BY ALL)"""

    return f"""
WITH k AS (SELECT DISTINCT client_id, kind, epoch_us(ts) AS us FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
w AS MATERIALIZED (SELECT client_id, kind, us, {nexts} FROM k WINDOW later AS (PARTITION BY client_id ORDER BY us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
p1 AS MATERIALIZED ({first}),
p2 AS MATERIALIZED ({second}),
p3 AS MATERIALIZED ({third}),
{counts(1)}, {counts(2)}, {counts(3)},
f AS (SELECT c1.funnel, c1.client_id, c1.n AS n1, c1.m AS n2, coalesce(c2.m, 0) AS n3, coalesce(c3.m, 0) AS n4,
  c1.ts[(c1.m + 1) // 2] AS t2, c2.ts[(c2.m + 1) // 2] AS t3, c3.ts[(c3.m + 1) // 2] AS t4
  FROM c1 LEFT JOIN c2 ON c2.funnel = c1.funnel AND c2.client_id = c1.client_id LEFT JOIN c3 ON c3.funnel = c1.funnel AND c3.client_id = c1.client_id),
g AS (SELECT *, CAST(CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS INTEGER) AS deepest FROM f)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, t2, t3, t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM g
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT r, doc_id, w, len(w) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM d),
q AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
x AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // l))) AS part FROM p JOIN f USING (term), s),
y AS (SELECT i, item_id, r, doc_id, CAST(sum(times * part) AS BIGINT) AS score FROM q JOIN x USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM y WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_lines": OP7_SQL, "op9_topk": OP9_SQL, "op11_funnels": _op11_sql(), "op13_ranked": OP13_SQL}
