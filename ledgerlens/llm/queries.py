"""The operators' queries, over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import chat_format, decontaminate, embedding_index, fill_middle, html_text, language_id, mixing, packing, quality, simhash, spelling, suffix_dedup, toxicity
from ledgerlens.llm.store import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id, n: int):
    return F.crc32(F.col(doc_id).cast("string")) % n


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text that lie in 400-byte strings which also start elsewhere, and words in passages of over 50 words that do, which can be shorter.

    Null texts are empty; equal rows are documents like others; no rows give no rows (so in all ten queries, where nothing else is said).
    """
    small_batches(spark)
    return suffix_dedup.repeats(table(spark, sf_dir, "documents"), passages=suffix_dedup.WORDS)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that overlap, with the best stretch; documents without any have no row."""
    small_batches(spark)
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned outside the held-out fold; ``und`` without a letter, ties to the first name. A null doc_id is not held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)))
    profiles = language_id.learn(docs.where(~F.col("held_out")))
    return language_id.predict(docs, profiles).select("doc_id", "held_out", "lang_pred", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, and its source's size and target."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every whole text, learned from ``labels`` outside the held-out fold; null and wordless texts are scored by the thresholds alone."""
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold_of("doc_id", 3) != 1))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "expected_severity", "p_toxic", "severity", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, three of 64 bits."""
    small_batches(spark)
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text, learned from ``labels`` outside the held-out fold; empty texts get an empty chunk's score."""
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.train(docs, labels.where(fold_of("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label")))
    out = quality.score(docs.select("doc_id", "text"), net)
    return out.select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; empty where there is none, or no html."""
    small_batches(spark)
    pages = html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


#: The conversation that the query adds to the table: control strings inside texts.
TRICKY = "\\### Assistant: </turn> ok"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with one whose texts hold control strings; rows of equal turn are ordered by role and text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("seq"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    events = rows.unionByName(added).withColumns({"kind": F.lit("message"), "message_id": F.lit(None).cast("string")})
    back = chat_format.read_back(chat_format.format_conversations(events))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; unusable ones link with nothing and are kept."""
    return embedding_index.near_duplicates(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more that occurs twice, one letter in some of its runs gone, with the frequent word that it is one edit from, and where such steps end."""
    return spelling.variants(table(spark, sf_dir, "documents"), every=31)


#: A vocabulary of the public tokenizers' package.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence of 4,096 tokens, and the place there, of every piece of every whole text; null texts are an end id alone."""
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut into lines and put out as prefix, suffix, middle in either order, with digests of the output and of the text rebuilt from it."""
    small_batches(spark)
    return fill_middle.digests(table(spark, sf_dir, "documents"))


_OP9_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), lengths AS (
  SELECT *, length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS escaped,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) AS escaped_role
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + escaped_role + 1 + escaped + 8 + CASE WHEN role = 'assistant' THEN 13 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM lengths GROUP BY conv_id
"""

_OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT u, w FROM pairs UNION SELECT r.u, p.w FROM reach AS r JOIN pairs AS p ON p.u = r.w
)
SELECT m.vec_id, (SELECT count(*) FROM pairs WHERE u = m.vec_id) AS n_links,
  least(m.vec_id, coalesce((SELECT min(w) FROM reach WHERE u = m.vec_id), m.vec_id)) AS component_id,
  m.vec_id <= coalesce((SELECT min(w) FROM reach WHERE u = m.vec_id), m.vec_id) AS kept
FROM embeddings AS m
"""

#: CRC-32 by a table of 256 values, made by its polynomial; near words by what is left without one letter.
_OP11_SQL = """
WITH RECURSIVE step AS (
  SELECT list(list_reduce(list_prepend(i, CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents
), each AS (
  SELECT run, count(*) AS k, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(id || ':' || run)) + 1), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i - 1, 2) AS BIGINT))) AS b
  FROM runs GROUP BY run, id
), hashed AS (
  SELECT run, k, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM each, step
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), without AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(i)
), pairs AS (
  SELECT a.word AS word, b.word AS other, b.n AS m FROM without AS a JOIN without AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without AS a JOIN words AS b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without AS a JOIN words AS b ON a.rest = b.word
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS place FROM pairs
), forms AS (
  SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.m >= 10 * w.n THEN r.other END AS form, CASE WHEN r.m >= 10 * w.n THEN r.m END AS form_n
  FROM words AS w LEFT JOIN ranked AS r ON r.word = w.word AND r.place = 1
), steps AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps AS s JOIN forms AS f ON f.word = s.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n
FROM forms AS f JOIN steps AS s ON s.word = f.word JOIN forms AS e ON e.word = s.root AND e.form IS NULL
"""

#: Units by splitting at line feeds, parts by counting characters: not the way the operator takes.
_OP13_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), split AS (
  SELECT *, string_split(t, chr(10)) AS pieces FROM texts
), lines AS (
  SELECT *, list_concat(list_transform(pieces[:-2], lambda x: x || chr(10)), list_filter(pieces[-1:], lambda x: x <> '')) AS u FROM split
), cuts AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 AS suffix_first
  FROM lines
), sizes AS (
  SELECT *, CAST(coalesce(list_sum(list_transform(u[:least(a, b)], lambda x: length(x))), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(list_transform(u[:greatest(a, b)], lambda x: length(x))), 0) AS BIGINT) AS q,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain
  FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
  CASE WHEN NOT plain THEN p END AS prefix_chars, CASE WHEN NOT plain THEN q - p END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN suffix_first THEN '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p)
    ELSE '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM sizes
"""

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_decontamination, op3_language_id, op4_mixing, op5_toxicity, op6_simhash, op7_quality, op8_html_extraction, op9_chat_formatting, op10_embedding_dedup, op11_spelling_variants, op12_best_fit_packing, op13_fill_in_middle)}
ORACLE_SQL = {"op9_chat_formatting": _OP9_SQL, "op10_embedding_dedup": _OP10_SQL, "op11_spelling_variants": _OP11_SQL, "op13_fill_in_middle": _OP13_SQL}
