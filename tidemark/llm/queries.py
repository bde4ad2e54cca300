"""Registered queries of the operators in this folder, and their check SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import codes, decontaminate, language, naming, pieces, quality, repeats, secrets, sharding, simhash, structure, toxicity, warc
from tidemark.session import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@query(
    "op1_exact_dedup",
    f"""WITH d AS (SELECT doc_id, {NORMAL} AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)""",
)
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_simhash_near_dedup")
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


@query("op9_language_filters")
def op9_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), DIGESTS)


@query("op5_karmarkar_karp")
def op5_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_bytes(table(spark, sf_dir, "documents"))


def _spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, {least} AS least, generate_subscripts(z, 1) AS pos, unnest(z) AS z
    FROM (SELECT doc_id, list_zip([length(x) FOR x IN string_split_regex(t, '{pattern}')],
                                  [length(x) FOR x IN regexp_extract_all(t, '{pattern}', 0)],
                                  [length(x) FOR x IN regexp_extract_all(t, '{pattern}', {group})]) AS z
          FROM d WHERE regexp_matches(t, '{pattern}'))"""


SECRETS = " UNION ALL ".join(
    [
        _spans("assign", 0, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        _spans("access", 1, "AKIA[A-Z0-9]+", 0, 20),
        _spans("hex", 2, "[0-9a-f]+", 0, 24),
        _spans("pem", 3, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0),
        _spans("jwt", 4, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ]
)


@query(
    "op6_secret_ledger",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({SECRETS}),
    s AS (SELECT *, sum(z[1] + z[2]) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS upto FROM m WHERE z[2] IS NOT NULL),
    f AS (SELECT *, kind || ':' || (upto - z[2])::BIGINT || ':' || upto::BIGINT AS span FROM s WHERE z[3] >= least),
    g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                 count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY upto - z[2], ord) AS spans,
                 string_agg(span, ',' ORDER BY upto - z[2], ord) FILTER (ord < 3) AS base
          FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (doc_id)""",
)
def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


_ALPHABET = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {}) & 31)::INT, 1)"
_BASE32 = " || ".join(_ALPHABET.format(shift) for shift in (15, 10, 5, 0))


@query(
    "op2_warc_segments",
    f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    h AS (SELECT *, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS first_id FROM p),
    b AS (SELECT page_id, string_agg({_BASE32}, '' ORDER BY g) AS payload_digest
          FROM (SELECT page_id, g, ('0x' || substr(hex, (1 + 5 * g)::INT, 5))::BIGINT AS v FROM h, range(8) r(g)) GROUP BY page_id)
    SELECT page_id, strlen(t)::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to, true AS valid
    FROM h JOIN b USING (page_id)""",
)
def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


@query("op4_toxicity_machine")
def op4_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_ordinal_quality")
def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.graded(table(spark, sf_dir, "documents"), quality.ratings(table(spark, sf_dir, "labels")))


@query(
    "op13_suffix_repeats",
    """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
    w AS (SELECT doc_id, p, h[p + 1 : p + 100] AS win FROM d, unnest(range(octet_length(h) - 99)) t(p)),
    r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1),
    runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (
               SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (
                 SELECT *, (p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 100)::INT AS new FROM r)) GROUP BY doc_id, run),
    cuts AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM runs GROUP BY 1),
    parts AS (SELECT d.doc_id, h, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed,
                     list_zip(list_concat([0], coalesce(lb, [])), list_concat(coalesce(la, []), [octet_length(h)])) AS z FROM d LEFT JOIN cuts USING (doc_id))
    SELECT doc_id, octet_length(h) AS n_bytes, n_removed, n_spans,
           sha256(unhex(list_aggregate([hex(h[x[1] + 1 : x[2]]) FOR x IN z], 'string_agg', ''))) AS kept_sha256
    FROM parts""",
)
def op13_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), ("n_bytes", "n_removed", "n_spans", "kept_sha256"))


def _lloyd_round(r: int) -> str:
    """SQL tables ``a<r>`` (nearest entries) and ``k<r + 1>`` (the means' floors; unused entries stay)."""
    return f"""a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (
      SELECT vec_id, q.part, q.x, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.x, k.x)])::BIGINT AS dist FROM q JOIN k{r} k USING (part)) GROUP BY 1, 2),
    k{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.x, k.x) AS x FROM k{r} k LEFT JOIN (SELECT part, e, list(m ORDER BY i) AS x FROM (
      SELECT part, e, i, floor(sum(v) / count(*))::BIGINT AS m FROM (SELECT part, e, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, e)),"""


@query(
    "op12_cover_tree_codes",
    f"""WITH v AS (SELECT vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
             WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    q AS MATERIALIZED (SELECT vec_id, part, x[(part * len(x) // 8 + 1)::BIGINT : ((part + 1) * len(x) // 8)::BIGINT] AS x FROM v, range(8) t(part)),
    k0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM q WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),
    {" ".join(_lloyd_round(r) for r in range(7))}
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM k6),
    c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a6 GROUP BY 1)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (vec_id), h""",
)
def op12_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


#: CRC-32 of ASCII text, bit by bit; lists hold the steps of the sums.
_CRC32 = """xor(4294967295, list_reduce([ord(x)::BIGINT FOR x IN string_split(name, '')],
    lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda v, k: xor(v >> 1, 3988292384 * (v & 1)), xor(c, b)), 4294967295::BIGINT))"""
_COST = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"


def _option(test: str, cost: str, letter: str, state: int, line: str) -> str:
    return f"CASE WHEN {test} THEN {{'c': {cost} + s{state}.c, 'a': '{letter}' || s{state}.a, 't': {line} || chr(10) || s{state}.t}} END"


def _state(s: int) -> str:
    """The cheapest, ASCII-least way on from state ``s`` by an edit of the row; Insert comes on top."""
    line, must = "role || ':' || text", "kind NOT IN ('b', 'd')"
    keep = [(i, to) for i, to, states in (("s", 1, (0,)), ("u", 2, (0, 1, 3)), ("a", 3, (2,))) if s in states]
    to, new = (3, "assistant") if s == 2 else (2, "user")
    options = [f"{{'c': 2 + s{s}.c, 'a': 'D' || s{s}.a, 't': s{s}.t}}"]
    options += [_option(f"{must} AND left(role, 1) = '{i}'", "cut", "K", t, line) for i, t in keep]
    options.append(_option(must, "1 + cut", "R", to, f"'{new}:' || text"))
    return f"list_sort([x FOR x IN [{', '.join(options)}] IF x IS NOT NULL])[1] AS b{s}"


def _insert(source: str, new: str) -> str:
    return f"{{'c': 5 + {source}.c, 'a': 'I' || {source}.a, 't': '{new}:' || chr(10) || {source}.t}}"


@query(
    "op11_checkpointed_repair",
    f"""WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
    f AS (SELECT *, {_CRC32} % 20 AS fault FROM n),
    d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
                 CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM f, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) r(copy)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text)) AS rn FROM d),
    k AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'd'
                 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS kind,
                 lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || left(role, 1) AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
    w AS (SELECT conv_id, n + 1 AS rn, {{'c': 0, 'a': '', 't': ''}}::{_COST} AS s0, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}}::{_COST} AS s1,
                 {{'c': 5, 'a': 'I', 't': 'assistant:' || chr(10)}}::{_COST} AS s2, {{'c': 0, 'a': '', 't': ''}}::{_COST} AS s3 FROM k WHERE rn = 1
          UNION ALL
          SELECT conv_id, rn, list_sort([b0, {_insert("z2", "user")}])[1]::{_COST}, list_sort([b1, {_insert("z2", "user")}])[1]::{_COST}, z2::{_COST}, z3::{_COST} FROM (
            SELECT *, list_sort([b2, {_insert("b3", "assistant")}])[1] AS z2, list_sort([b3, {_insert("b2", "user")}])[1] AS z3 FROM (
              SELECT conv_id, rn, {", ".join(_state(s) for s in range(4))} FROM (
                SELECT k.conv_id, k.rn, role, text, kind, CASE kind WHEN 't' THEN 5 ELSE 0 END AS cut, s0, s1, s2, s3
                FROM w JOIN k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.rn = w.rn - 1)))),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate,
                 count(*) FILTER (kind = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY 1),
    e AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(left(s0.t, length(s0.t) - 1), '')) AS repaired_sha256
    FROM e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM e.conv_id AND w.rn = 1""",
)
def op11_checkpointed_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return structure.report(conversations, structure.damaged(conversations))
