"""The registered queries of the training-data operators and their check SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    chat, conversation_repair, decontamination, exact_dedup, html_text, line_dedup, mixing,
    ngram_join, personal_data, quality, spelling, token_counts, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function
    return register


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


@_query("op1_benchmark_decontamination")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_leaks(_read(spark, folder, "documents"),
                                      _read(spark, folder, "benchmark"))


@_query("op2_exact_dedup", f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x
           FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size, sha256(x) AS text_sha256
      FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, g.text_sha256
FROM t JOIN g ON t.x = g.x""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, folder, "documents"))


@_query("op3_mixing_to_weights", f"""
WITH d AS (SELECT doc_id, source,
                  coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS o
           FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS s,
              row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
       FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(r % 3 + 1)::INT]::BIGINT AS w FROM s0),
-- Sources reach their cap in the order of size by weight; the first k are capped.
s2 AS (SELECT *, sum(s) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS weights,
              coalesce(sum(s) OVER k, 0)::BIGINT AS s_before,
              coalesce(sum(w) OVER k, 0)::BIGINT AS w_before
       FROM s1
       WINDOW k AS (ORDER BY s::DOUBLE / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, w::HUGEINT * (150 * total - 200 * s_before) > 200 * s::HUGEINT * (weights - w_before)
              OR s = 0 AS capped
       FROM s2),
f AS (SELECT sum(CASE WHEN capped THEN 0 ELSE w END)::BIGINT AS free,
             (150 * max(total) - 200 * sum(CASE WHEN capped THEN s ELSE 0 END))::BIGINT AS rest
      FROM s3),
t AS (SELECT source, s, r, CASE WHEN capped THEN 2.0::DOUBLE * s
                           ELSE (w * rest)::DOUBLE / (100 * free)::DOUBLE END AS target,
             CASE WHEN capped THEN 2 * s ELSE (w * rest) // (100 * free) END::BIGINT AS whole
      FROM s3, f),
p AS (SELECT d.doc_id, d.size, t.s AS source_size, t.target, t.whole, t.r,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size
                               ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS a
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, whole - a)) AS one,
             greatest(0, least(size, whole - source_size - a)) AS two,
             a::DOUBLE / whole AS x, (source_size + a)::DOUBLE / whole AS y,
             CASE r % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 ELSE 1.5 END AS l,
             CASE r % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.0 ELSE -1.0 END AS g
      FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN one > 0 THEN floor(1000000 * (2 * x / (l + sqrt(l * l + 2 * g * x))))::BIGINT END
           AS first_position,
       CASE WHEN two > 0 THEN floor(1000000 * (2 * y / (l + sqrt(l * l + 2 * g * y))))::BIGINT END
           AS second_position
FROM q""")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_read(spark, folder, "documents"))


@_query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, folder, "documents"),
                                    _read(spark, folder, "labels"), threshold=0.3)


@_query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_read(spark, folder, "documents"),
                                  _read(spark, folder, "labels"), threshold=0.7)


_GUARDED = (r"<\\*\||<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>"
            r"|<\\*start_of_turn>|<\\*end_of_turn>")
_SPEC = "</s>[INST] ok [/INST]"


@_query("op6_chat_formatting", f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{_SPEC}'
           UNION ALL SELECT -1, 1, 'assistant', '{_SPEC}'),
x AS (SELECT *, length('<|im_start|>') + length('<|im_sep|>') + length('<|im_end|>') + 1
             + length(role) + len(regexp_extract_all(role, '{_GUARDED}'))
             + length(text) + len(regexp_extract_all(text, '{_GUARDED}')) AS chars
      FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
           AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    special = spark.createDataFrame(
        [(-1, 0, "user", _SPEC), (-1, 1, "assistant", _SPEC)],
        "conv_id long, turn long, role string, text string")
    messages = _read(spark, folder, "conversations").select(*special.columns).union(special)
    return chat.conversation_digests(chat.format_messages(messages))


@_query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_read(spark, folder, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@_query("op8_html_extraction")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(_read(spark, folder, "pages"))


@_query("op9_line_dedup", f"""
WITH l AS (SELECT doc_id, source, i, trim(line, ' ' || chr(9) || chr(13)) AS line
           FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s,
                        unnest(s) AS line, unnest(range(len(s))) AS i
                 FROM documents WHERE text IS NOT NULL)),
k AS (SELECT line, min(struct_pack(doc_id := doc_id, i := i)) AS first
      FROM l WHERE line <> '' GROUP BY line
      HAVING count(DISTINCT coalesce('s' || source, 'null')) >= {line_dedup.MIN_SITES}),
r AS (SELECT l.doc_id, list(l.i) AS gone FROM l JOIN k ON l.line = k.line
      WHERE struct_pack(doc_id := l.doc_id, i := l.i) <> k.first GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l WHERE line <> '' GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN r.gone IS NULL THEN d.text ELSE array_to_string(
           list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(r.gone, i - 1)),
           chr(10)) END AS text,
       coalesce(n.n_lines, 0)::INT AS n_lines, coalesce(len(r.gone), 0)::INT AS n_removed
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.remove_spread_lines(_read(spark, folder, "documents")).select(
        "doc_id", "text", "n_lines", "n_removed")


@_query("op10_ngram_jaccard_join", f"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w
    FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS x
      FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(m.n) AS n, any_value(o.n) AS o
      FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
           JOIN n m ON m.doc_id = a.doc_id JOIN n o ON o.doc_id = b.doc_id
      WHERE 100 * least(m.n, o.n) >= 90 * greatest(m.n, o.n)
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(m.n) + any_value(o.n) - count(*))),
r AS (SELECT a AS d, b AS c FROM e UNION SELECT r.d, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles,
       least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
     LEFT JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = d.doc_id""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents")
    return ngram_join.ngram_components(docs, n_words=3, percent=90).select(
        "doc_id", "n_shingles", "component_id")


def _crc_sql(text: str) -> str:
    """The crc32 of a SQL text of ASCII and Latin letters; needs the one-row table `crc`."""
    octets = (f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128"
              " THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))")
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}::BIGINT[]), lambda c, b:"
            " xor(c >> 8, crc.steps[(xor(c, b) & 255) + 1])))")


_CRC_TABLE = """crc AS (SELECT [list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    FOR i IN range(256)] AS steps)"""


_RUN = "[A-Za-z\u00C0-\u00FF]{6,}"


def _runs(docs: DataFrame) -> DataFrame:
    """The lower-cased letter runs of all texts, one in 199 without one of its code points. Runs under
    six code points cannot give a word of six."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))).alias(
        "run")).withColumn("run", F.translate("run", _UPPER, _LOWER))
    hashed = runs.withColumn("h", F.crc32(F.concat(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % 199 == 0, less).otherwise(F.col("run")).alias("word"))


@_query("op11_spelling_variants", f"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{_RUN}')), '{_UPPER}', '{_LOWER}') AS run
      FROM documents),
k AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY doc_id, run),
h AS (SELECT run, c, {_crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM k, crc),
v AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2)
                  ELSE run END AS word, c
      FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
g AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS part
      FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word, b.word AS other FROM g a JOIN g b ON a.i = b.i AND a.part = b.part
             AND a.word <> b.word
         UNION SELECT g.word, w.word FROM g JOIN w ON g.part = w.word
         UNION SELECT w.word, g.word FROM g JOIN w ON g.part = w.word),
b AS (SELECT near.word, count(*) AS n_near, max(w.n) AS most,
             min(struct_pack(less := -w.n, other := other)).other AS best
      FROM near JOIN w ON near.other = w.word GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
             CASE WHEN b.most >= 5 * w.n THEN b.best END AS form,
             CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n
      FROM w LEFT JOIN b ON b.word = w.word),
t AS (SELECT word, word AS root FROM f
      UNION SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
e AS (SELECT t.word, t.root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_runs(_read(spark, folder, "documents"))))


@_query("op12_personal_data")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data.find_personal_data(
        _read(spark, folder, "documents").select("doc_id", "text"), carry=["doc_id"])
    base = F.filter("found", lambda s: s["kind"] != "term")
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, "term")) - F.size(F.array_remove(F.array_remove(
        kinds, "term"), k)) for k in personal_data.KINDS[:4]]
    return found.select("doc_id", *[c.cast("long").alias(f"n_{k}")
                                    for c, k in zip(counts, personal_data.KINDS)],
                        F.sha2(personal_data.spans_text(base), 256).alias("base_sha256"),
                        personal_data.spans_text(F.col("found")).alias("spans"))


def _damaged(messages: DataFrame) -> DataFrame:
    """Messages damaged by the crc32 of conversation and turn; nulls are one space."""
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = messages.select(
        "conv_id", "turn", fate.alias("fate"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(
            text).alias("text"))
    return rows.filter(F.col("fate") != 0).withColumn("_copy", F.explode(
        F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop(
        "fate", "_copy")


def _step(after: str, cost: str, edit: str, line: str | None) -> str:
    rest = f"{after}.r" if line is None else f"list_prepend({line}, {after}.r)"
    return f"{{'c': {cost} + {after}.c, 'a': '{edit}' || {after}.a, 'r': {rest}}}"


def _inserted(v: str) -> str:
    """The four states where one empty row may be inserted first."""
    def best(q, to, role):
        return f"list_min([{v}[{q}], {_step(f'{v}[{to}]', '5', 'I', repr(role))}])"
    return "[" + ", ".join([best(1, 3, "user:"), best(2, 3, "user:"), best(3, 4, "assistant:"),
                            best(4, 3, "user:")]) + "]"


def _consumed(q: int, to: int, role: str) -> str:
    """One state in front of a row: it is kept, given another role or deleted."""
    line = "f.role || ':' || f.text"
    fits = {1: "CASE f.x WHEN 's' THEN 2 WHEN 'u' THEN 3 END", 2: "CASE f.x WHEN 'u' THEN 3 END",
            3: "CASE f.x WHEN 'a' THEN 4 END", 4: "CASE f.x WHEN 'u' THEN 3 END"}[q]
    kept = _step(f"v[{fits}]", "f.more", "K", line)
    new = _step(f"v[{to}]", "f.more + 1", "R", f"'{role}:' || f.text")
    return (f"list_min(list_filter([{_step(f'v[{q}]', '2', 'D', None)}, CASE WHEN NOT f.gone"
            f" AND {fits} IS NOT NULL THEN {kept} END, CASE WHEN NOT f.gone THEN {new} END],"
            " lambda s: s IS NOT NULL))")


@_query("op13_conversation_repair", f"""
WITH RECURSIVE {_CRC_TABLE},
m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}
                 % 20 AS fate
      FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
             CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                       ELSE text END AS text,
             unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM m WHERE fate <> 0),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS x,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)
                 AS z
      FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS n FROM o),
f AS (SELECT *, z = '' AS blank, z <> '' AND n > 1 AS duplicate,
             z NOT IN ('', '.', '!', '?') AND n = 1 AS truncated, blank OR duplicate AS gone,
             CASE WHEN truncated THEN 5 ELSE 0 END AS more,
             coalesce(lag(x) OVER w || x NOT IN ('su', 'ua', 'au'), false) AS illegal
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
e AS (SELECT conv_id, max(i) + 1 AS i,
             [{{'c': 0, 'a': '', 'r': []::VARCHAR[]}}, {{'c': 99999999, 'a': '', 'r': []::VARCHAR[]}},
              {{'c': 99999999, 'a': '', 'r': []::VARCHAR[]}}, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}}]
                 AS v
      FROM f GROUP BY conv_id),
p AS (SELECT conv_id, i, {_inserted("u")} AS v FROM (SELECT conv_id, i, {_inserted("v")} AS u FROM e)
      UNION ALL
      SELECT conv_id, i, {_inserted("u")} AS v
      FROM (SELECT conv_id, i, {_inserted("t")} AS u
            FROM (SELECT f.conv_id, f.i, [{_consumed(1, 3, "user")}, {_consumed(2, 3, "user")},
                         {_consumed(3, 4, "assistant")}, {_consumed(4, 3, "user")}] AS t
                  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i - 1))),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
             count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
      FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank,
       coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(p.v[1].c, 0)::BIGINT AS cost,
       coalesce(p.v[1].a, '') AS audit,
       sha256(coalesce(array_to_string(p.v[1].r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
     LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
     LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.i = 1""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    messages = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    repairs = conversation_repair.repair(_damaged(messages))
    ids = messages.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found, digests = repairs.conversations, conversation_repair.repaired_digests(repairs)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    joined = conversation_repair.matched(
        conversation_repair.matched(ids, found, ["conv_id"], "left"), digests, ["conv_id"], "left")
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
