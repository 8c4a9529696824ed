"""The training-data operators as registered queries with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.llm.decontaminate import contained_items
from tidebars.llm.documents import read_table
from tidebars.llm.exact_dedup import exact_duplicates
from tidebars.llm.language import fit_language, identify_language
from tidebars.llm.licenses import scan_licenses
from tidebars.llm.mixing import mix_sources, taken_words
from tidebars.llm.phrases import remove_repeats
from tidebars.llm.pieces import encode_pieces, piece_digests
from tidebars.llm.prefix_trie import conversation_trie
from tidebars.llm.quality import fit_quality, score_quality
from tidebars.llm.secret_scan import find_secrets
from tidebars.llm.sharding import shard_documents
from tidebars.llm.simhash import near_duplicates
from tidebars.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern and by randomness of tokens."""
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    digest = F.sha2("base_spans", 256).alias("base_sha256")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", digest, "spans", "n_random")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of words and n-grams."""
    documents = read_table(spark, sf_dir, "documents")
    return identify_language(documents, fit_language(documents))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, the row with the largest id staying."""
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE["op3_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by fingerprints of three-word shingles within three bits."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of almost equal row counts."""
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=16)


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures."""
    return scan_licenses(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base_starts").cast("long").alias("n_base"),
        F.array_min("base_starts").cast("long").alias("first_word"),
        F.array_max("base_starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose shingles of five words lie in a document by 80 % or more."""
    found = contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", "shingles", "containment")


_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')"
_SHINGLES = "SELECT DISTINCT id, list_slice(w, i, i + 4) AS shingle FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM {}) s"
ORACLE["op7_decontamination"] = f"""WITH items AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark), texts AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents),
 a AS ({_SHINGLES.format("items")}), b AS ({_SHINGLES.format("texts")}), n AS (SELECT id, count(*) AS shingles FROM a GROUP BY id)
SELECT b.id AS doc_id, a.id AS item_id, count(*) AS shared, any_value(n.shingles) AS shingles, count(*) / any_value(n.shingles) AS containment
FROM a JOIN b ON a.shingle = b.shingle JOIN n ON n.id = a.id
GROUP BY b.id, a.id HAVING count(*) >= 0.8 * any_value(n.shingles) - 1e-9
"""


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_digests(encode_pieces(read_table(spark, sf_dir, "documents"), model))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when repeated passages of 35 words and more are removed."""
    left = remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op9_substring_dedup"] = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
 windows AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)),
 again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
 each AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM t),
 reach AS (SELECT e.r, e.p, e.word, a.i AS start FROM each e ASOF LEFT JOIN again a ON e.r = a.r AND e.p >= a.i),
 judged AS (SELECT r, p, word, coalesce(p < start + 35, false) AS gone FROM reach),
 kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS left_ FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
"""


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its nearest labelled neighbours."""
    documents = read_table(spark, sf_dir, "documents")
    return score_quality(documents, fit_quality(documents, read_table(spark, sf_dir, "labels")))


@query
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mixture of all sources by weights 5, 2, 1 takes of each document."""
    return taken_words(mix_sources(read_table(spark, sf_dir, "documents")))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whiten(read_table(spark, sf_dir, "embeddings"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


# crc32 bit by bit: a number of 0 and more takes in a byte, -1 shifts one bit out
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
  lambda ch: [ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
ORACLE["op13_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
 own AS (SELECT c, list(v ORDER BY p) AS vs FROM t GROUP BY c),
 fam AS (SELECT c, vs, c - c % 5 AS b, {_CRC} % 9 AS h FROM own),
 built AS (SELECT f.c, list_concat(coalesce(list_slice(o.vs, 1, f.h), []), coalesce(list_slice(f.vs, f.h + 1, len(f.vs)), [])) AS s FROM fam f LEFT JOIN own o ON o.c = f.b),
 pre AS (SELECT c, len(s) AS len, d, list_slice(s, 1, d) AS k, CASE WHEN d > 0 THEN s[d].t ELSE '' END AS txt FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
 nodes AS (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(octet_length(encode(txt))) AS b,
   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends_sha256 FROM pre GROUP BY k, d),
 kids AS (SELECT list_slice(k, 1, d - 1) AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
 full_ AS (SELECT n.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * b AS own_saved FROM nodes n LEFT JOIN kids USING (k, d)),
 below AS (SELECT list_slice(k, 1, a) AS k, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(own_saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves, below.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below ON below.k = f.k AND below.d = f.d LEFT JOIN full_ u ON f.d > 0 AND u.d = f.d - 1 AND u.k = list_slice(f.k, 1, f.d - 1)
"""
