"""The registered queries of the corpus operators, and their SQL where SQL can say it.

Each query applies its operator with production parameters to whole tables
and derives the contract's digest columns from the operator's results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitsliced import top_k
from .decontamination import marked
from .html_extraction import extract
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .mixing import mix
from .quality import classify
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .token_counts import encoded_lengths, length_histogram


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with the words that the mix takes of each."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    out = marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines of three-line windows that occurred before."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_lines", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked where 90 % of their three-word shingles are shared."""
    out = jaccard_components(table(spark, sf_dir, "documents"), k=3, t=0.9)
    return out.select("doc_id", "n_shingles", "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 100-byte strings that start earlier."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every query row, whose ids are divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 100 = 0"), rows).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 24 shards."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents with its suffix sums."""
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the classifier's score and decision."""
    return classify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_decontamination, op3_line_dedup, op4_html_extraction, op5_jaccard_join,
        op6_suffix_dedup, op7_top_k, op8_sharding, op9_token_counts, op10_quality,
    )
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
        iw AS (
          SELECT DISTINCT item_id, len, array_to_string(list_slice(w, s, s + len - 1), ' ') AS win
          FROM (SELECT item_id, w, least(len(w), 10) AS len, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)
        ), dw AS (
          SELECT doc_id, len, s, array_to_string(list_slice(w, s, s + len - 1), ' ') AS win
          FROM (SELECT doc_id, w, len, unnest(generate_series(1, len(w) - len + 1)) AS s FROM d, (SELECT DISTINCT len FROM iw) WHERE len(w) >= len)
        ), h AS (SELECT DISTINCT doc_id, s, dw.len, item_id FROM dw JOIN iw ON dw.len = iw.len AND dw.win = iw.win),
        hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + len - 1)) AS p FROM h) GROUP BY doc_id),
        hi AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), '') AS x FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
    """,
    "op5_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        g AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
        m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, d.doc_id) AS component_id
        FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = a
    """,
    "op3_line_dedup": """
        WITH l AS (
          SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS i
          FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE length(text) > 0)
        ), w AS (
          SELECT doc_id, i, line AS a, lead(line, 1) OVER p AS b, lead(line, 2) OVER p AS c
          FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)
        ), f AS (
          SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM w WHERE c IS NOT NULL
        ), r AS (
          SELECT DISTINCT doc_id, i + o AS i FROM f, (VALUES (0), (1), (2)) t(o) WHERE nth > 1
        ), k AS (
          SELECT l.doc_id, l.i, l.line, r.i IS NOT NULL AS gone FROM l LEFT JOIN r ON l.doc_id = r.doc_id AND l.i = r.i
        ), m AS (
          SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM k
        ), g AS (
          SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
                 coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept
          FROM m GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN g USING (doc_id)
    """,
    "op6_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        n AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
        s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS w FROM (SELECT doc_id, x, unnest(generate_series(0, n - 100)) AS i FROM n WHERE n >= 100)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS nth FROM s) WHERE nth > 1),
        r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run
              FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM late)),
        p AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY ALL),
        q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS after FROM p),
        k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(substr(x, 2 * after + 1, 2 * (a - after)), '' ORDER BY a) AS kept
              FROM q JOIN n USING (doc_id) GROUP BY doc_id)
        SELECT n.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
        FROM n LEFT JOIN k USING (doc_id)
    """,
    "op7_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
          FROM embeddings
          WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
          SELECT a.vec_id AS query_id, b.vec_id,
                 CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE a.vec_id % 100 = 0
        ), r AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
