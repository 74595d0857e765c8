"""The subpackage's queries, one for each operator, and their SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.bpe import bpe_encode
from lodestar.llm.collocations import collocations
from lodestar.llm.decontaminate import scan_documents
from lodestar.llm.html_text import extract_text
from lodestar.llm.jaccard import jaccard_components
from lodestar.llm.langid import dictionaries, identify
from lodestar.llm.licenses import scan_licenses
from lodestar.llm.merkle import merkle_manifest, tampered_text
from lodestar.llm.mih import nearest
from lodestar.llm.mixing import mix_documents
from lodestar.llm.surrogates import replace_pii
from lodestar.llm.warc import archived
from lodestar.llm.wavprint import text_media
from lodestar.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(f, sql: str | None = None):
    QUERIES[f.__name__] = f
    if sql:
        ORACLES[f.__name__] = sql


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each row of embeddings whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: (doc_id, text, n_entities)."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as WAV, read back, with its spectral-peak pairs as arrays (the media themselves are the operator's keep=True)."""
    return text_media(table(spark, sf_dir, "documents"), keep=False)


def op4_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded: counts and digests."""
    return bpe_encode(table(spark, sf_dir, "documents"), digests=True)


def held_out(id_col: str = "doc_id"):
    """Rows that language ID may not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    raw = dictionaries(docs.where(~held_out()))
    return identify(docs, raw).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and template labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op7_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's copies in the mix of its source's target."""
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, written, normalised and read back."""
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of four-word shingle sets at 85 %."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and fold in the manifest of all of them, some texts having changed since."""
    return merkle_manifest(table(spark, sf_dir, "documents"), tampered_text())


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and benchmark items met with windows of ten words."""
    return scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of two to four words by cohesion."""
    return collocations(table(spark, sf_dir, "documents"))


_add(op1_multi_index_hashing)
_add(op2_pii_surrogates)
_add(op3_wav_fingerprints)
_add(op4_bpe_prefix_dp)
_add(op5_language_id)
_add(op6_license_templates)
_add(op7_entropy_balancing)
_add(
    op8_warc_normaliser,
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
               sha256(coalesce(html, '')) AS payload_digest
        FROM pages),
    q AS (
        SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM q
    """,
)
_add(op9_html_text)
_add(
    op10_ngram_jaccard,
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM w, unnest(range(1, len(w) - 2)) t(i) WHERE len(w) >= 4
        UNION ALL
        SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
    r AS (SELECT doc_id, doc_id AS d FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.d)
    SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.d) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
)
#: SQL for lower-casing A-Z alone, and for the CRC-32 of a number's decimal digits.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT_FIELD = "coalesce(octet_length(encode({0})) || ':' || {0}, '-')"


def _level(below: str, name: str) -> str:
    """SQL of the level above one: each group that has several nodes left is hashed by sixteens, others stay."""
    return f"""
    {name} AS (SELECT g, CASE WHEN m > 1 THEN i // 16 ELSE i END AS i, CASE WHEN m > 1 THEN (m + 15) // 16 ELSE 1 END AS m,
                      CASE WHEN any_value(m) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d
               FROM {below} GROUP BY g, CASE WHEN m > 1 THEN i // 16 ELSE i END, m)"""


def _step(below: str, nodes: str, name: str) -> str:
    """SQL of the leaves' proofs and folds one level up."""
    run = f"FROM {nodes} s WHERE s.g = p.g AND s.i // 16 = p.i // 16"
    return f"""
    {name}s AS (SELECT g, i, coalesce(string_agg(d, '' ORDER BY i) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                       coalesce(string_agg(d, '' ORDER BY i) OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM {nodes} WINDOW r AS (PARTITION BY g, i // 16 ORDER BY i)),
    {name} AS (SELECT p.* REPLACE (CASE WHEN p.m > 1 THEN p.i // 16 ELSE p.i END AS i, CASE WHEN p.m > 1 THEN (p.m + 15) // 16 ELSE 1 END AS m,
                      CASE WHEN p.m > 1 THEN p.proof || s.l || s.r ELSE p.proof END AS proof,
                      CASE WHEN p.m > 1 THEN sha256(s.l || p.f || s.r) ELSE p.f END AS f)
               FROM {below} p JOIN {name}s s ON s.g = p.g AND s.i = p.i)"""


def _merkle_sql() -> str:
    """Five levels over each source's leaves and four over the sources: enough for the tables that SQL is run on."""
    sql = f"""
    WITH c AS (SELECT {_CRC_TABLE} AS t),
    x AS (SELECT doc_id, source, sha256({_FIELDS} || '' || {_TEXT_FIELD.format("text")}) AS leaf, text, {_CRC} % 5 = 0 AS struck,
                 sha256({_FIELDS} || {_TEXT_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS low FROM documents, c),
    p0 AS (SELECT doc_id, leaf, CASE WHEN struck THEN low ELSE leaf END AS f, '' AS proof, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g,
                  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM x),
    n0 AS (SELECT g, i, m, leaf AS d FROM p0)"""
    for k in range(1, 6):
        sql += "," + _level(f"n{k - 1}", f"n{k}") + "," + _step(f"p{k - 1}", f"n{k - 1}", f"p{k}")
    sql += """,
    q0 AS (SELECT p.doc_id, p.leaf, p.f, p.proof, n.d AS subroot, 0 AS g, p.g AS i, (SELECT count(*) FROM n5) AS m FROM p5 p JOIN n5 n ON n.g = p.g),
    s0 AS (SELECT 0 AS g, g AS i, count(*) OVER () AS m, d FROM n5)"""
    for k in range(1, 5):
        sql += "," + _level(f"s{k - 1}", f"s{k}") + "," + _step(f"q{k - 1}", f"s{k - 1}", f"q{k}")
    return sql + """
    SELECT doc_id, leaf, subroot, s4.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = s4.d AS verified FROM q4, s4"""


_add(op11_merkle_manifest, _merkle_sql())
_add(
    op12_decontamination,
    rf"""
    WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT DISTINCT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
    g AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM b, unnest(range(1, len(w) - m + 2)) t(i)),
    u AS (SELECT DISTINCT m FROM g),
    h AS (SELECT k, i, d.m, s FROM (SELECT k, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM d, u, unnest(range(1, len(w) - m + 2)) t(i)) d
          WHERE EXISTS (SELECT 1 FROM g WHERE g.s = d.s AND g.m = d.m)),
    c AS (SELECT k, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + m)) t(j) GROUP BY k),
    n AS (SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h JOIN g USING (m, s) GROUP BY k)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (k) LEFT JOIN n USING (k)
    """,
)
_add(
    op13_collocations,
    rf"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
    p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM d, unnest(pieces) t(p)),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
    f AS (SELECT lang, w[i:i + m - 1] AS s, count(*) AS f FROM p, unnest(range(1, 5)) u(m), unnest(range(1, len(w) - m + 2)) t(i) GROUP BY ALL HAVING count(*) >= 30),
    c AS (SELECT lang, s, f AS a FROM f WHERE len(s) > 1),
    x AS (SELECT c.lang, c.s, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
          FROM c, unnest(range(1, len(s))) t(k) JOIN f l ON l.lang = c.lang AND l.s = c.s[:k] JOIN f r ON r.lang = c.lang AND r.s = c.s[k + 1:]),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
    o AS (SELECT lang, s[i:i + m - 1] AS s, max(a) AS longer FROM c, unnest(range(2, 4)) u(m), unnest(range(1, len(s) - m + 2)) t(i) WHERE m < len(s) GROUP BY ALL),
    z AS (SELECT lang, array_to_string(s, ' ') AS phrase, a, l, r, score FROM y LEFT JOIN o USING (lang, s) WHERE longer IS NULL OR 100 * longer < 80 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM z JOIN n USING (lang) QUALIFY rank <= 2000
    """,
)
