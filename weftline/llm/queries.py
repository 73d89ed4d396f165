"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbour_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.html_text import extracted

    return extracted(spark, table(spark, sf_dir, "pages"))


def op2_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.quality import judged

    return judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.token_files import token_files

    return token_files(spark, table(spark, sf_dir, "documents"))


def op4_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.packing import packed

    return packed(spark, table(spark, sf_dir, "documents"))


def op5_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.passages import repeats

    return repeats(spark, table(spark, sf_dir, "documents")).drop("ver")


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontaminate import contamination

    return contamination(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op7_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.url_rules import filtered

    return filtered(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op8_template_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.license_scan import scan

    return scan(spark, table(spark, sf_dir, "documents"))


def op9_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.class_lm import scored

    return scored(spark, table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.near_dedup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


#: Windows of item words as texts between commas, so that an occurrence is a place in the text of words.
OP6_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ',') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ',') AS s FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT p.k, p.n, p.i, x.item FROM places p JOIN windows x ON p.n = x.n AND p.s = x.s),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM found) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT k, item FROM found) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_prefix_join": OP6_SQL}
