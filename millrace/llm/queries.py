"""The registered queries of the training-data operators: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 5:2:1 mix of the sources takes from each document."""
    from millrace.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 400-byte strings that occur elsewhere."""
    from millrace.llm.suffix_dedup import removal

    return removal(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's 4-word-shingle SimHash and its component by links of up to 4 bits."""
    from millrace.llm.simhash import near_duplicates

    of = near_duplicates(_table(spark, sf_dir, "documents"))
    return of.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level BPE tokens and of the text decoded from them."""
    from millrace.llm.bpe import digests

    coded = digests(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by hashed subword embeddings."""
    from millrace.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


#: The rules of the url query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by url rules and, without one, by its host's place in the link graph."""
    from millrace.llm.linkgraph import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op7_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in wavelet-matrix token shards, read back from the files."""
    from millrace.llm.wavelet import read_documents, shard_starts, write_shards

    shards = write_shards(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return read_documents(shard_starts(shards))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the verdict of the fertility bands of its language."""
    from millrace.llm.fertility import judge

    return judge(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_multi_50k.tiktoken")).drop("text_hash")


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal row counts on a bounded-load ring."""
    from millrace.llm.ring import shard_rows

    placed = shard_rows(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


def op10_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of near-duplicates of its label and its component."""
    from millrace.llm.epsgrid import near_duplicates

    of = near_duplicates(_table(spark, sf_dir, "embeddings"))
    return of.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word's near words, more frequent form and root, after planted slips."""
    from millrace.llm.variants import spelling_variants, vocabulary

    return spelling_variants(vocabulary(_table(spark, sf_dir, "documents"), slips=True)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, the cheapest edits and the repaired text's digest of every conversation, after planted damage."""
    from millrace.llm.conversations import damage, repair, text_digests

    turns = _table(spark, sf_dir, "conversations")
    summary, rows = repair(damage(turns))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = turns.select("conv_id").distinct().unionByName(summary, True).unionByName(text_digests(rows), True)
    zero = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return parts.groupBy("conv_id").agg(*zero, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), empty).alias("repaired_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document by all rules, counted and digested for the base rules."""
    from millrace.llm.secret_scan import secrets

    found = secrets(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("found", lambda x: x["base"]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


#: The mix in SQL: the same hashes, thresholds as running sums in hash order.
OP1_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(md5(text), '~')), 1, 15))::BIGINT AS h
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM base GROUP BY source
), weighted AS (
  SELECT source, n, 3 * n AS cap, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(n) OVER () AS total FROM per
), filling AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS cap_before, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_open
  FROM weighted WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (total - cap_before)::BIGINT AS rest, w_open::BIGINT AS w_open FROM filling
  WHERE (total - cap_before) * w <= cap * w_open ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, n, CASE WHEN rest * w > cap * w_open THEN cap::DOUBLE ELSE (rest * w)::DOUBLE / w_open END AS target,
         CASE WHEN rest * w > cap * w_open THEN cap * w_open ELSE rest * w END AS target_num, w_open
  FROM weighted, level
), parts AS (
  SELECT source, n, target, CASE WHEN n = 0 THEN 0 ELSE target_num // (w_open * n) END AS whole,
         CASE WHEN n = 0 THEN 0 ELSE target_num - (target_num // (w_open * n)) * w_open * n END AS rest_num, w_open
  FROM targets
), by_hash AS (
  SELECT source, h, sum(s) OVER (PARTITION BY source ORDER BY h) AS upto, s FROM (SELECT source, h, sum(size) AS s FROM base GROUP BY source, h)
)
SELECT b.doc_id, b.size, p.n AS source_size, p.target, (b.size * c.copies)::BIGINT AS taken, c.copies::INTEGER AS copies
FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source
JOIN by_hash x ON x.source IS NOT DISTINCT FROM b.source AND x.h = b.h,
LATERAL (SELECT p.whole + CASE WHEN p.rest_num > 0 AND (x.upto - x.s) * p.w_open < p.rest_num
           AND p.rest_num - (x.upto - x.s) * p.w_open > x.upto * p.w_open - p.rest_num THEN 1 ELSE 0 END AS copies) c
"""

#: All pairs of a label by their cosines in double precision, and components by reachability.
OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach(node, root) AS (
  SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), least AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.root, e.vec_id) AS component_id, coalesce(l.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least l ON l.node = e.vec_id
"""

#: Table steps of CRC-32 in SQL: one row with the list ``crc`` of 256 values, from the polynomial.
CRC_TABLE = "crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS crc FROM range(256) r(i))"


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, given ``crc`` of :data:`CRC_TABLE`."""
    octets = f"list_transform(range(0, strlen({text})), lambda k: ('0x' || substr(hex({text}), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295)"


#: Spelling variants in SQL: words meet on what a deletion leaves, at the same place for a replacement.
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (SELECT run, times, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(times)::BIGINT AS n FROM hashed GROUP BY 1
), v AS (SELECT word, n FROM words WHERE length(word) >= 5 AND n >= 3),
cut AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.rest UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.rest
), best AS (SELECT word, count(*) AS n_near, min({{'m': -m, 'other': other}}) AS b FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * v.n THEN b.other END AS form, CASE WHEN -b.m >= 2 * v.n THEN (-b.m)::BIGINT END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, here) AS (SELECT word, word FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.here AS root FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

#: The repair in SQL: a recursion over turns carries the least (cost, audit, text) of each state.
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair,
    CASE WHEN cut = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM placed
), ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
rows_ AS (SELECT ids.c, m.* FROM marked m JOIN ids ON ids.conv_id IS NOT DISTINCT FROM m.conv_id),
fold(c, k, e, s, u, a) AS (
  SELECT c, 0::BIGINT, {{'cost': 0::BIGINT, 'audit': '', 'body': ''}}, NULL::STRUCT(cost BIGINT, audit VARCHAR, body VARCHAR), NULL::STRUCT(cost BIGINT, audit VARCHAR, body VARCHAR), NULL::STRUCT(cost BIGINT, audit VARCHAR, body VARCHAR) FROM ids
  UNION ALL
  SELECT c, k, {{'cost': e.cost + 2, 'audit': e.audit || 'D', 'body': e.body}},
    least(CASE WHEN s IS NOT NULL THEN {{'cost': s.cost + 2, 'audit': s.audit || 'D', 'body': s.body}} END, CASE WHEN ok AND i = 's' THEN {{'cost': e.cost + p, 'audit': e.audit || 'K', 'body': e.body || line}} END),
    least(CASE WHEN u IS NOT NULL THEN {{'cost': u.cost + 2, 'audit': u.audit || 'D', 'body': u.body}} END, CASE WHEN ok AND o IS NOT NULL THEN {{'cost': o.cost + p + (i <> 'u')::BIGINT, 'audit': o.audit || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END, 'body': o.body || CASE WHEN i = 'u' THEN line ELSE chr(10) || 'user:' || text END}} END),
    least(CASE WHEN a IS NOT NULL THEN {{'cost': a.cost + 2, 'audit': a.audit || 'D', 'body': a.body}} END, CASE WHEN ok AND u IS NOT NULL THEN {{'cost': u.cost + p + (i <> 'a')::BIGINT, 'audit': u.audit || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END, 'body': u.body || CASE WHEN i = 'a' THEN line ELSE chr(10) || 'assistant:' || text END}} END)
  FROM (
    SELECT *, least(e, s, a) AS o FROM (
      SELECT *, least(a0, CASE WHEN u IS NOT NULL THEN {{'cost': u.cost + 5, 'audit': u.audit || 'I', 'body': u.body || chr(10) || 'assistant:'}} END) AS a FROM (
        SELECT f.c, r.k, f.e, f.s, f.a AS a0, r.f NOT IN ('b', 'd') AS ok, CASE WHEN r.f = 't' THEN 5 ELSE 0 END AS p, r.i, r.text, chr(10) || r.role || ':' || r.text AS line,
          least(f.u, CASE WHEN least(f.e, f.s, f.a) IS NOT NULL THEN {{'cost': least(f.e, f.s, f.a).cost + 5, 'audit': least(f.e, f.s, f.a).audit || 'I', 'body': least(f.e, f.s, f.a).body || chr(10) || 'user:'}} END) AS u
        FROM fold f JOIN rows_ r ON r.c = f.c AND r.k = f.k + 1)))
), ended AS (SELECT c, e, a, least(u, {{'cost': least(e, s, a).cost + 5, 'audit': least(e, s, a).audit || 'I', 'body': least(e, s, a).body || chr(10) || 'user:'}}) AS u FROM fold QUALIFY k = max(k) OVER (PARTITION BY c)),
best AS (SELECT c, least(e, a, {{'cost': u.cost + 5, 'audit': u.audit || 'I', 'body': u.body || chr(10) || 'assistant:'}}) AS b FROM ended),
sums AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  b.cost AS cost, b.audit AS audit, sha256(substr(b.body, 2)) AS repaired_sha256
FROM ids LEFT JOIN sums USING (c) JOIN best USING (c)
"""


def _any_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


#: The rules of the secret scan as regular expressions: kind, match with the counted part as group 3, least length of that part.
SECRET_SQL = [
    ("assign", "(?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", "AKIA([A-Z0-9]+)", 14),
    ("hex", "([0-9a-f]+)", 16),
    ("private_key", "-----BEGIN (?:|RSA |EC |DSA |OPENSSH |ENCRYPTED )(PRIVATE KEY-----)", 1),
    ("code_host", "gh[pousr]_([A-Za-z0-9]+)", 36),
    ("chat", "xox[abprs]-([A-Za-z0-9-]+)", 10),
    ("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 8),
    ("url_login", "://[A-Za-z0-9._~-]+:[A-Za-z0-9._~!$%&*+=-]+(@)", 1),
]
#: The scan in SQL: each rule by itself, a text as gaps and matches in turn, so that lengths add up to places.
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rules(n, kind, least) AS (VALUES {", ".join(f"({k}, '{kind}', {least})" for k, (kind, _, least) in enumerate(SECRET_SQL))}),
lists AS ({" UNION ALL ".join(f"SELECT r, {k} AS n, regexp_extract_all(t, '(?s)(.*?)(?:({p})|$)', 1) AS g, regexp_extract_all(t, '(?s)(.*?)(?:({p})|$)', 2) AS m, regexp_extract_all(t, '(?s)(.*?)(?:({p})|$)', 3) AS v FROM d" for k, (_, p, _) in enumerate(SECRET_SQL))}),
each AS (SELECT r, n, generate_subscripts(g, 1) AS i, unnest(g) AS g, unnest(m) AS m, unnest(v) AS v FROM lists),
placed AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY r, n ORDER BY i) AS e FROM each),
spans AS (SELECT r, n, kind, kind || ':' || (e - length(m)) || ':' || e AS s, e - length(m) AS b FROM placed JOIN rules USING (n) WHERE m <> '' AND length(v) >= least),
sums AS (SELECT r, count(*) FILTER (n = 0) AS a, count(*) FILTER (n = 1) AS k, count(*) FILTER (n = 2) AS h, string_agg(s, ',' ORDER BY b, n) FILTER (n < 3) AS base, string_agg(s, ',' ORDER BY b, n) AS every FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN sums USING (r)
"""


def queries() -> dict:
    return {"op1_source_mix": op1_source_mix, "op2_suffix_dedup": op2_suffix_dedup, "op3_simhash": op3_simhash, "op4_bpe": op4_bpe, "op5_langid": op5_langid, "op6_url_filter": op6_url_filter, "op7_wavelet_shards": op7_wavelet_shards, "op8_fertility": op8_fertility, "op9_ring_shards": op9_ring_shards, "op10_embedding_dups": op10_embedding_dups, "op11_spelling_variants": op11_spelling_variants, "op12_conversation_repair": op12_conversation_repair, "op13_secret_scan": op13_secret_scan}


def oracle_sql() -> dict:
    return {"op1_source_mix": OP1_SQL, "op10_embedding_dups": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_secret_scan": OP13_SQL}
