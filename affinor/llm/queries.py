"""The registered queries of this subpackage and their SQL."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from affinor.llm.common import table
from affinor.llm.decontaminate import decontaminate
from affinor.llm.exact_dedup import exact_dedup
from affinor.llm.html_text import extract
from affinor.llm.jaccard_join import jaccard_join
from affinor.llm.language import identify_all
from affinor.llm.mixing import mix
from affinor.llm.packing import pack_documents
from affinor.llm.pii import replace_personal_data
from affinor.llm.ranked_search import ranked_search
from affinor.llm.runs import repeat_tails, run_report
from affinor.llm.sharding import shard_documents
from affinor.llm.token_index import token_index
from affinor.llm.toxicity import toxicity
from affinor.session import scratch_path

QUERIES, ORACLES = {}, {}
SHARDS = 16
TOKENIZER = "word_bpe_49k.json"
KEY = "surrogates of the registered query"  # a parameter: real runs pass a secret


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_sharding(spark, sf_dir):
    placed = shard_documents(table(spark, sf_dir, "documents"), SHARDS, scratch_path(spark, "slot-map"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                         "virtual_slot", "map_version")


@query
def op2_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""


@query
def op4_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@query
def op5_language(spark, sf_dir):
    return identify_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


@query
def op6_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_token_index(spark, sf_dir):
    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op10_personal_data(spark, sf_dir):
    return replace_personal_data(table(spark, sf_dir, "documents"), KEY)


@query
def op11_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).drop("row")


@query
def op12_ranked_search(spark, sf_dir):
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_ranked_search"] = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50"""


@query
def op13_periodic_runs(spark, sf_dir):
    return run_report(repeat_tails(table(spark, sf_dir, "documents")))


# Equal words q apart, as islands on each diagonal; an island counts unless one of a divisor of its period spans it. The checksum of the
# decimal id is spelled out bit by bit (polynomial 0xEDB88320).
ORACLES["op13_periodic_runs"] = r"""WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    coalesce(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295::BIGINT), 1) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
x AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM t),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
c AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM k GROUP BY doc_id, q, island HAVING count(*) >= greatest(12 - q, q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.doc_id = c.doc_id AND o.q < c.q AND c.q % o.q = 0 AND o.s <= c.s AND o.s + o.n >= c.s + c.n)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, s, q) AS place FROM r),
d AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM r GROUP BY doc_id),
u AS (SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.s + r.q AND x.i < r.s + r.n) GROUP BY x.doc_id)
SELECT t.doc_id, t.n::BIGINT AS n_words, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n::BIGINT AS length, b.q AS period, (1000 * b.n // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, coalesce(n_kept, 0) AS n_kept, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN d USING (doc_id) LEFT JOIN (SELECT * FROM b WHERE place = 1) b USING (doc_id) LEFT JOIN u USING (doc_id)"""
