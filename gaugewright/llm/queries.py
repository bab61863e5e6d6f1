"""The queries of this subpackage, and SQL giving the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe_codec, centroid_search, containment, embedding_forest, html_extraction, interpolated_lm, jaccard_join, language_id, line_spread, repeated_bytes, sentencepiece_codec, spelling_variants, toxicity
from .text import fold
from .words import small

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def piece_model() -> str:
    """The vocabulary file used by the queries; another path can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op9_sentencepiece")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return token_digests(read(spark, folder, "documents"))


def token_digests(docs: DataFrame) -> DataFrame:
    out = sentencepiece_codec.encode_decode(docs, piece_model())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op12_byte_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and decoded text of every document by byte pairs, as digests."""
    out = byte_bpe_codec.encode_decode(read(spark, folder, "documents"), byte_vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op1_embedding_forest")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector, among vectors of its label."""
    return embedding_forest.near_duplicate_vectors(read(spark, folder, "embeddings"))


@query("op3_repeated_bytes")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the strings of 100 bytes that start earlier."""
    out = repeated_bytes.remove_repeats(read(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four folds of five."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").select("doc_id", "toxic").where(F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0))
    model = toxicity.train(docs.join(small(labels), "doc_id"))
    return toxicity.score(docs, model).withColumn("held_out", fold("doc_id", 5) == 0)


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three folds of four."""
    docs = read(spark, folder, "documents")
    model = language_id.train(docs.where(fold("doc_id", 4) != 2))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op6_interpolated_lm")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document, by a model of six folds of seven."""
    held_out = fold("doc_id", 7) == 2
    docs = read(spark, folder, "documents")
    return interpolated_lm.score(docs, ~held_out).withColumn("held_out", held_out)


@query("op7_html_extraction")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page. The number in a page's path names the document that its article shows; that labels the training pages."""
    pages = read(spark, folder, "pages").select("page_id", "url", "html")
    number = F.expr("try_cast(nullif(regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/([0-9]+)', 1), '') AS bigint)")
    model = html_extraction.train(pages.withColumn("article_id", number), read(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), "text"))
    return html_extraction.extract(pages, model)


def _cluster_sql(rounds: int = 5) -> str:
    """Plain clustering: every vector against every centroid, round by round."""
    parts = [
        """kept AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    )""",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY cluster LIMIT 40)",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
      SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, k := cluster)) AS best
      FROM (SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept, c{r}) GROUP BY vec_id
    )""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
      SELECT cluster, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN (
        SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM (
          SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT best.k AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY cluster, i
        ) GROUP BY cluster
      ) m USING (cluster)
    )""")
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} ON best.k = cluster"""


@query("op11_centroid_search", _cluster_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster, distance and inertia of every vector of 64 components."""
    found = centroid_search.cluster(read(spark, folder, "embeddings"))
    digests = found.table().select("cluster", F.sha2(F.array_join("centroid", ",").cast("binary"), 256).alias("centroid_sha256"))
    out = centroid_search.with_inertia(found).join(F.broadcast(digests), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _crc_table() -> list[int]:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


@query(
    "op13_spelling_variants",
    f"""WITH RECURSIVE runs AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
    ),
    counted AS MATERIALIZED (SELECT run, hex(doc_id || ':' || run) AS code, count(*) AS n FROM runs GROUP BY ALL),
    tab AS (SELECT {_crc_table()} AS t),
    hashed AS MATERIALIZED (
      SELECT run, n, xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(0, len(code) // 2), lambda i: CAST('0x' || code[2 * i + 1:2 * i + 2] AS BIGINT))),
        lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) AS h FROM counted, tab
    ),
    vocabulary AS MATERIALIZED (
      SELECT w AS word, CAST(sum(n) AS BIGINT) AS n
      FROM (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS w, n FROM hashed)
      WHERE len(w) >= 6 GROUP BY w HAVING sum(n) >= 5
    ),
    cut AS MATERIALIZED (
      SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM vocabulary)
    ),
    near AS (
      SELECT DISTINCT word, n, other, other_n FROM (
        SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION ALL SELECT a.word, a.n, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
        UNION ALL SELECT b.word, b.n, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word
      )
    ),
    best AS (SELECT word, n, count(*) AS n_near, min(struct_pack(low := -other_n, o := other)) AS m FROM near GROUP BY word, n),
    formed AS MATERIALIZED (SELECT word, n_near, CASE WHEN -m.low >= 5 * n THEN m.o END AS form, CASE WHEN -m.low >= 5 * n THEN -m.low END AS form_n FROM best),
    chain AS (
      SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
      UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
    ),
    ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
    SELECT v.word, form, coalesce(root, v.word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
    FROM vocabulary v LEFT JOIN formed USING (word) LEFT JOIN ends USING (word)""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Words of six characters or more, what they are variants of, and how many words are one edit away."""
    return spelling_variants.variants(spelling_variants.misspelt_words(read(spark, folder, "documents")))


_WORDS = r"string_split(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
_SHINGLES = """
{name}_words AS (SELECT {id}, """ + _WORDS + """ AS w FROM {table}),
{name}_sets AS (
  SELECT DISTINCT {id}, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS shingle
  FROM (SELECT {id}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM {name}_words WHERE w[1] <> '')
)"""
_DOC_SETS = _SHINGLES.format(name="doc", id="doc_id", table="documents", text="text")
_ITEM_SETS = _SHINGLES.format(name="item", id="item_id", table="benchmark", text="text")


@query(
    "op2_containment",
    f"""WITH {_DOC_SETS}, {_ITEM_SETS},
    sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_sets GROUP BY ALL),
    found AS (SELECT doc_id, item_id, count(*) AS n_found FROM doc_sets JOIN item_sets USING (shingle) GROUP BY ALL)
    SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
    FROM found JOIN sizes USING (item_id) WHERE n_found / n_shingles >= 0.8 - 1e-12""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that each document contains."""
    return containment.contained_items(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query(
    "op8_jaccard_join",
    f"""WITH RECURSIVE {_DOC_SETS},
    sizes AS (SELECT doc_id, count(*) AS n, min(shingle) AS low, string_agg(shingle, '|' ORDER BY shingle) AS whole FROM doc_sets GROUP BY ALL),
    classes AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM sizes),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM doc_sets a JOIN doc_sets b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    pairs AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
    links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    roots AS (SELECT a, least(a, min(b)) AS low FROM reach GROUP BY a),
    degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(low, d.doc_id) AS group_id, coalesce(low, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN classes USING (doc_id) LEFT JOIN roots r ON r.a = d.doc_id LEFT JOIN degrees g ON g.a = d.doc_id""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Class, links and group of every document by word 5-grams at a Jaccard similarity of 0.8."""
    return jaccard_join.near_duplicates(read(spark, folder, "documents"))


@query(
    "op10_line_spread",
    f"""WITH cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    spread AS (
      SELECT trim(line) AS body, min(struct_pack(d := doc_id, p := pos)) AS first FROM cut WHERE trim(line) <> ''
      GROUP BY 1 HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}
    ),
    marked AS (SELECT doc_id, pos, line, body IS NOT NULL AND first <> struct_pack(d := doc_id, p := pos) AS gone FROM cut LEFT JOIN spread ON trim(line) = body),
    kept AS (
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id
    )
    SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(k.text) AS text_sha256
    FROM documents d LEFT JOIN kept k USING (doc_id)""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Lines on ten sites or more leave every document but the first that has them."""
    out = line_spread.remove_spread_lines(read(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
