"""Registered queries of the core operators over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import scanners as S
from granary.functions import text as T
from granary.operators import diversity, governance, judging, metrics, overlap, planning, retrieval, validate
from granary.plans.registry import register
from granary.session import numbered, spread
from granary.sources import store
from granary.sources.tables import table

_NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_WORDS = "regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+')"
_LOWER_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
_SHINGLES = "CASE WHEN {0} = '' THEN [] WHEN len(string_split({0}, '')) <= 5 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 3), lambda i: array_to_string(string_split({0}, '')[i:i+4], ''))) END"


def norm(c: str) -> str:
    return _NORM.format(c)


def words(c: str) -> str:
    return _WORDS.format(c)


# ---------------------------------------------------------------------------- text functions


@register("f1_normalised", f"SELECT doc_id, md5({norm('text')}) AS digest, length({norm('text')}) AS n_chars FROM documents")
def f1(spark, d):
    n = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.normalise(F.col("text")).alias("n"))
    return n.select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("bigint").alias("n_chars"))


@register("f2_shingle_counts", f"""WITH n AS (SELECT item_id, {norm('text')} AS t FROM held_out), c AS (SELECT item_id, t, string_split(t, '') AS l FROM n)
SELECT item_id, CASE WHEN t = '' THEN 0 WHEN len(l) <= 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i+4], '')))) END::BIGINT AS shingles FROM c""")
def f2(spark, d):
    return table(spark, d, "held_out").select("item_id", F.size(T.shingles(T.normalise(F.col("text")))).cast("bigint").alias("shingles"))


@register("f6_token_counts", f"SELECT doc_id, len({words('text')})::BIGINT AS words, len(list_distinct({words('text')}))::BIGINT AS distinct_words FROM documents WHERE text IS NOT NULL")
def f6(spark, d):
    w = T.tokens(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.size(w).cast("bigint").alias("words"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct_words"))


_KEYWORD = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\\s-]+', '_', 'g'), '[^a-z0-9_.]', '', 'g'), '^[_.]+|[_.]+$', '', 'g')"


@register("f9_keywords", f"SELECT {_KEYWORD.format('keyword')} AS keyword, count(*) AS n FROM seed_questions WHERE keyword IS NOT NULL GROUP BY 1")
def f9(spark, d):
    return table(spark, d, "seed_questions").filter("keyword is not null").groupBy(T.keyword(F.col("keyword")).alias("keyword")).agg(F.count(F.lit(1)).alias("n"))


@register("f11_excerpts", "SELECT seed_id, rtrim(substring(trim(regexp_replace(question, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'), ' '), 1, 80), ' ') AS excerpt FROM seed_questions WHERE question IS NOT NULL")
def f11(spark, d):
    return table(spark, d, "seed_questions").filter("question is not null").select("seed_id", T.excerpt(F.col("question"), 80).alias("excerpt"))


_NUMBERS = "regexp_extract_all({0}, '[-+]?\\d[\\d,]*\\.?\\d*')"


@register("f15_numeric_answers", f"""WITH t AS (SELECT seed_id, regexp_extract_all(response, '[Ff]inal [Aa]nswer:?\\s*([^\\n]+)', 1) AS tails, {_NUMBERS.format('response')} AS numbers, response FROM seed_questions WHERE response IS NOT NULL), x AS (SELECT seed_id, tails[-1] AS tail, numbers FROM t)
SELECT seed_id, replace(CASE WHEN tail IS NOT NULL AND tail <> '' THEN coalesce({_NUMBERS.format('tail')}[1], trim(tail)) ELSE numbers[-1] END, ',', '') AS answer FROM x""")
def f15(spark, d):
    return table(spark, d, "seed_questions").filter("response is not null").select("seed_id", T.numeric_answer(F.col("response")).alias("answer"))


@register("f14_boxed_answers", """WITH t AS (SELECT seed_id, replace(response, ',', '') AS r FROM seed_questions WHERE response IS NOT NULL)
SELECT seed_id, coalesce(trim(regexp_extract_all(r, '\\\\boxed\\{(.*?)\\}', 1)[-1]), trim(regexp_extract_all(r, '(?i)final answer is:?\\s*(.*)', 1)[-1]), regexp_extract_all(r, '[-+]?\\d*\\.?\\d+')[-1]) AS answer FROM t""")
def f14(spark, d):
    return table(spark, d, "seed_questions").filter("response is not null").select("seed_id", T.boxed_answer(F.col("response")).alias("answer"))


@register("f17_yes_no_maybe", """SELECT seed_id, coalesce(lower(nullif(regexp_extract(response, '(?i)answer:\\s*(yes|no|maybe)', 1), '')), CASE WHEN starts_with(lower(trim(response)), 'yes') THEN 'yes' WHEN starts_with(lower(trim(response)), 'no') THEN 'no' WHEN starts_with(lower(trim(response)), 'maybe') THEN 'maybe' END) AS answer FROM seed_questions WHERE response IS NOT NULL""")
def f17(spark, d):
    return table(spark, d, "seed_questions").filter("response is not null").select("seed_id", T.yes_no_maybe(F.col("response")).alias("answer"))


@register("f16_choice_answers", """SELECT seed_id, coalesce(nullif(regexp_extract(response, '[Aa]nswer:\\s*([A-D])', 1), ''), nullif(regexp_extract(response, '(?:^|[^\\p{L}\\p{N}_])([A-D])(?:$|[^\\p{L}\\p{N}_])', 1), '')) AS answer FROM seed_questions WHERE response IS NOT NULL""")
def f16(spark, d):
    return table(spark, d, "seed_questions").filter("response is not null").select("seed_id", T.choice_answer(F.col("response")).alias("answer"))


@register("f18_option_counts", "SELECT seed_id, len(list_distinct(regexp_extract_all(question, '(?m)^\\s*\\(?([A-D])[).:]\\s', 1)))::BIGINT AS options FROM seed_questions WHERE question IS NOT NULL")
def f18(spark, d):
    return table(spark, d, "seed_questions").filter("question is not null").select("seed_id", F.size(T.option_labels(F.col("question"))).cast("bigint").alias("options"))


@register("f19_token_estimates", "SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, round(sum(ceil(length(text) / 4.0)) * 4.0 / 1e6, 9) AS cost FROM documents GROUP BY source")
def f19(spark, d):
    t = F.sum(T.token_estimate(F.col("text")))
    return table(spark, d, "documents").groupBy("source").agg(t.alias("tokens"), F.round(T.cost(t, F.lit(0), 4.0, 20.0), 9).alias("cost"))


@register("f21_record_ids", "SELECT seed_id, sha256(coalesce(strlen(qa_key) || ':' || qa_key, '-:') || coalesce(strlen(bloom_level) || ':' || bloom_level, '-:')) AS record_id FROM seed_questions")
def f21(spark, d):
    return table(spark, d, "seed_questions").select("seed_id", T.content_id(F.col("qa_key"), F.col("bloom_level")).alias("record_id"))


@register("p1r_record_texts", """SELECT seed_id, md5(regexp_replace(array_to_string(list_filter(list_transform(messages, lambda m: m.content), lambda c: c IS NOT NULL), chr(10)), '^[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{3000}]+|[\\s\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{3000}]+$', '', 'g')) AS digest FROM seed_conversations WHERE len(list_filter(coalesce(messages, []), lambda m: m.content IS NOT NULL)) > 0""")
def p1r(spark, d):
    """Texts of the conversations that have a message with content; of other records all public strings would be the text."""
    c = table(spark, d, "seed_conversations").select("seed_id", "messages")
    return c.filter(F.exists("messages", lambda m: m["content"].isNotNull())).select("seed_id", F.md5(governance.record_text(c)).alias("digest"))


@register("p2_public_strings", """WITH s AS (SELECT seed_id, unnest([question, response, answer, keyword]) AS t FROM seed_questions UNION ALL SELECT seed_id, unnest(messages).content FROM seed_conversations UNION ALL SELECT seed_id, unnest(secondary_topics) FROM seed_conversations)
SELECT seed_id, count(t) AS strings, sum(length(t))::BIGINT AS chars FROM s WHERE t IS NOT NULL GROUP BY seed_id""")
def p2s(spark, d):
    """Number and length of the public strings of every record, found by walking its schema."""
    q = governance.explode_strings(table(spark, d, "seed_questions").select("seed_id", "question", "response", "answer", "keyword"))
    c = governance.explode_strings(table(spark, d, "seed_conversations").select("seed_id", F.transform("messages", lambda m: F.struct(m["turn"].alias("turn"), m["content"].alias("content"))).alias("messages"), "secondary_topics"))
    return q.unionByName(c).groupBy(F.col("id").alias("seed_id")).agg(F.count(F.lit(1)).alias("strings"), F.sum(F.length("text")).alias("chars"))


# ---------------------------------------------------------------------------- joins and similarity


@register("j2_best_held_out_item", f"""WITH i AS (SELECT item_id, unnest(s) AS g, len(s) AS n FROM (SELECT item_id, {_SHINGLES.format('t')} AS s FROM (SELECT item_id, {norm('text')} AS t FROM held_out WHERE text IS NOT NULL))),
d AS (SELECT doc_id, unnest(s) AS g, len(s) AS n FROM (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN len(l) <= 5 THEN [t] ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: l[i] || l[i+1] || l[i+2] || l[i+3] || l[i+4])) END AS s FROM (SELECT doc_id, t, string_split(t, '') AS l FROM (SELECT doc_id, {norm('text')} AS t FROM documents WHERE text IS NOT NULL)))),
c AS (SELECT doc_id, item_id, count(*) / (any_value(d.n) + any_value(i.n) - count(*)) AS score FROM d JOIN i USING (g) GROUP BY ALL)
SELECT doc_id, item_id, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) = 1""")
def j2(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return overlap.best_match(docs, table(spark, d, "held_out")).select(F.col("id").alias("doc_id"), "item_id", F.round("score", 6).alias("score"))


@register("j3_near_duplicates", f"""WITH n AS (SELECT doc_id, {norm('text')} AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS class_id FROM n),
g AS (SELECT doc_id AS id, unnest(s) AS g, len(s) AS n FROM (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN len(l) <= 5 THEN [t] ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: l[i] || l[i+1] || l[i+2] || l[i+3] || l[i+4])) END AS s FROM (SELECT doc_id, t, string_split(t, '') AS l FROM c WHERE doc_id = class_id))),
p AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM g a JOIN g b ON a.g = b.g AND a.id < b.id AND least(a.n, b.n) > 0.8 * greatest(a.n, b.n) GROUP BY a.id, b.id),
l AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM p WHERE score > 0.8 UNION ALL SELECT b FROM p WHERE score > 0.8) GROUP BY id)
SELECT doc_id AS id, class_id, coalesce(links, 0)::BIGINT AS links FROM c LEFT JOIN l ON l.id = c.class_id""")
def j3(spark, d):
    """Class of exact copies and number of near classes of every document."""
    return overlap.near_duplicates(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@register("j4_nearest_vectors", """WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT query_id, vec_id, list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]) AS cosine FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, vec_id, round(cosine, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS rank FROM c QUALIFY rank <= 3""")
def j4(spark, d):
    v = table(spark, d, "embeddings")
    return overlap.nearest_vectors(v.filter("vec_id % 50 = 0"), v, 3).select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), "rank")


@register("j7_records_by_cell", """SELECT c.task, c.cell_id, count(q.seed_id) AS n FROM coverage_cells c LEFT JOIN seed_questions q ON q.cell_id = c.cell_id GROUP BY ALL""")
def j7(spark, d):
    cells = table(spark, d, "coverage_cells")
    return metrics.coverage(cells, table(spark, d, "seed_questions")).join(cells.select("cell_id", "task"), "cell_id").select("task", "cell_id", F.col("accepted").alias("n"))


@register("j6_pending", """SELECT q.seed_id FROM seed_questions q WHERE NOT EXISTS (SELECT 1 FROM ballots b WHERE b.record_id = q.seed_id AND b.vote = q.answer)""")
def j6(spark, d):
    """Questions whose answer nobody voted for, as items that wait for a decision."""
    items = table(spark, d, "seed_questions").select(F.col("seed_id").alias("item_id"), "answer")
    right = items.join(table(spark, d, "ballots").select(F.col("record_id").alias("item_id"), "vote"), "item_id").filter(F.col("vote") == F.col("answer"))
    return store.pending(items, right).select(F.col("item_id").alias("seed_id"))


@register("j11_span_issues", """WITH s AS (SELECT seed_id, messages, unnest(spans) AS s FROM seed_conversations), x AS (SELECT seed_id, list_filter(messages, lambda m: m.turn = s.turn) AS same, s FROM s)
SELECT seed_id, CASE WHEN len(same) = 0 THEN 'span_turn' ELSE 'span_text' END AS code, count(*) AS n FROM x
WHERE len(same) = 0 OR NOT coalesce(list_bool_or(list_transform(same, lambda m: coalesce(contains(m.content, s.text), false))), false) GROUP BY ALL""")
def j11(spark, d):
    i = F.explode(validate.span_issues(F.col("messages"), F.col("spans"))).alias("i")
    return table(spark, d, "seed_conversations").select("seed_id", i).groupBy("seed_id", F.col("i.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------- retrieval and diversity


@register("t1_bm25", f"""WITH w AS (SELECT doc_id AS id, coalesce({_LOWER_WORDS.format('text')}, []) AS w FROM documents), len AS (SELECT id, len(w) AS dl FROM w), av AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM len),
p AS (SELECT id, unnest(w) AS term FROM w), tf AS (SELECT term, id, count(*) AS tf FROM p GROUP BY ALL),
r AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, av GROUP BY term, n), idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
q AS (SELECT item_id AS query_id, unnest({_LOWER_WORDS.format('text')}) AS term FROM held_out WHERE item_id % 50 = 0),
s AS (SELECT query_id, id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (id), av GROUP BY ALL)
SELECT query_id, id AS doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s QUALIFY rank <= 10""")
def t1(spark, d):
    index = retrieval.build_index(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    queries = table(spark, d, "held_out").filter("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.search(index, queries).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@register("a25_idf", f"""WITH p AS (SELECT doc_id AS id, unnest({_LOWER_WORDS.format('text')}) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT term, count(DISTINCT id) AS df, ln(n - count(DISTINCT id) + 0.5) - ln(count(DISTINCT id) + 0.5) AS raw FROM p, n GROUP BY term, n)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r""")
def a25(spark, d):
    return retrieval.build_index(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register("a1_distinct_1", f"WITH g AS (SELECT lang, unnest({words('text')}) AS g FROM documents) SELECT lang, round(count(DISTINCT g) / count(*), 6) AS distinct_1 FROM g GROUP BY lang")
def a1(spark, d):
    return diversity.distinct_n(table(spark, d, "documents"), 1, ["lang"]).filter("distinct_1 is not null").select("lang", F.round("distinct_1", 6).alias("distinct_1"))


@register("a1_distinct_2", f"""WITH w AS (SELECT {words('response')} AS w FROM seed_questions), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS g FROM w) SELECT round(count(DISTINCT g) / count(*), 6) AS distinct_2 FROM g""")
def a1b(spark, d):
    return diversity.distinct_n(table(spark, d, "seed_questions").select(F.col("response").alias("text")), 2).select(F.round("distinct_2", 6).alias("distinct_2"))


@register("a2_self_bleu", f"""WITH w AS (SELECT seed_id AS id, {words('response')} AS w FROM seed_questions WHERE response IS NOT NULL), k AS (SELECT id, w, len(w) AS len FROM w WHERE len(w) > 0),
g AS (SELECT id, n, unnest(list_transform(range(1, len - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS g FROM k, range(1, 5) r(n) WHERE len >= n), c AS (SELECT id, n, g, count(*) AS c FROM g GROUP BY ALL),
o AS (SELECT n, g, id, c, coalesce(max(c) OVER (PARTITION BY n, g ORDER BY c DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(max(c) OVER (PARTITION BY n, g ORDER BY c DESC, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after FROM c),
p AS (SELECT id, n, sum(least(c, greatest(before, after))) AS hit, sum(c) AS total FROM o GROUP BY id, n), q AS (SELECT id, avg(ln(CASE WHEN hit = 0 THEN 0.1 ELSE hit END / total)) AS lp FROM p GROUP BY id),
s AS (SELECT len, count(*) AS m, lag(len) OVER (ORDER BY len) AS low, lead(len) OVER (ORDER BY len) AS high FROM k GROUP BY len), r AS (SELECT len, CASE WHEN m > 1 THEN len WHEN low IS NULL THEN high WHEN high IS NULL THEN low WHEN len - low <= high - len THEN low ELSE high END AS ref FROM s)
SELECT round(avg(exp(lp + CASE WHEN len >= ref THEN 0 ELSE 1 - ref / len END)), 6) AS self_bleu FROM q JOIN k USING (id) JOIN r USING (len)""")
def a2(spark, d):
    """Self-BLEU of all responses."""
    return diversity.self_bleu(table(spark, d, "seed_questions").select(F.col("seed_id").alias("id"), F.col("response").alias("text"))).select(F.round("self_bleu", 6).alias("self_bleu"))


@register("a3_cluster_entropy")
def a3(spark, d):
    """Entropy of k-means clusters of the vectors."""
    return diversity.cluster_entropy(table(spark, d, "embeddings"))


# ---------------------------------------------------------------------------- governance


def _conversation_texts(spark, d):
    return governance.explode_messages(spread(table(spark, d, "seed_conversations").select("seed_id", "messages")))


@register("g1_pii_findings")
def g1(spark, d):
    """Positions of personal-data rules in every message; look-behinds have no counterpart in SQL here."""
    return governance.redacted(governance.scan_pii(_conversation_texts(spark, d)))


@register("g1_email_counts", r"""WITH m AS (SELECT seed_id AS id, unnest(messages).content AS t FROM seed_conversations)
SELECT id, sum(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b')))::BIGINT AS emails FROM m WHERE t LIKE '%@%' GROUP BY id HAVING emails > 0""")
def g1e(spark, d):
    t = _conversation_texts(spark, d).filter(F.col("text").contains("@"))
    return t.groupBy("id").agg(F.sum(S.count(F.col("text"), S.PII["email"])).cast("bigint").alias("emails")).filter("emails > 0")


def _tox_sql(category: str) -> str:
    alt = "|".join(f"(?:{f})" for f in S.TOXICITY[category]).replace("'", "''")
    return f"SELECT id, '{category}' AS category FROM m WHERE regexp_matches(t, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_''])(?:{alt})(?:$|[^\\p{{L}}\\p{{N}}_])')"


@register("g4_toxic_messages", "WITH m AS (SELECT seed_id AS id, unnest(messages).content AS t FROM seed_conversations), f AS (" + " UNION ALL ".join(_tox_sql(c) for c in S.TOXICITY) + ") SELECT id, category, count(*) AS messages FROM f GROUP BY ALL")
def g4(spark, d):
    t = _conversation_texts(spark, d)
    hits = F.array_compact(F.array(*[F.when(S.has(F.col("text"), S.toxicity_pattern(c)), F.lit(c)) for c in S.TOXICITY]))
    return t.select("id", F.explode(hits).alias("category")).groupBy("id", "category").agg(F.count(F.lit(1)).alias("messages"))


@register("g6_secrets")
def g6(spark, d):
    """Secrets in documents."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("path"), "text")
    return governance.redacted(governance.scan_secrets(t))


@register("g7_entities", """WITH m AS (SELECT seed_id AS id, unnest(messages).content AS t FROM seed_conversations)
SELECT id, sum(len(regexp_extract_all(t, '(?i)\\b(?:northgate\\s+overdraft|flexi\\s+till|lantern\\s+fx)\\b')))::BIGINT AS n FROM m GROUP BY id HAVING n > 0""")
def g7(spark, d):
    return governance.scan_entities(_conversation_texts(spark, d), ["Northgate Overdraft", "Flexi Till", "Lantern FX"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("g9_sensitive_identifiers")
def g9(spark, d):
    """Digit runs in questions that no personal-data rule covers."""
    t = table(spark, d, "seed_questions").select(F.col("seed_id").alias("id"), F.lit("question").alias("path"), F.col("question").alias("text"))
    return governance.redacted(governance.sensitive_identifiers(t))


# ---------------------------------------------------------------------------- validation

_TURNS = """WITH m AS (SELECT seed_id, unnest(messages) AS m, generate_subscripts(messages, 1) - 1 AS i FROM seed_conversations), e AS (SELECT seed_id, i, m.turn AS turn, m.role AS role, CASE WHEN i % 2 = 0 THEN 'customer' ELSE 'assistant' END AS want FROM m),
x AS (SELECT seed_id, 'turn_numbering' AS code FROM e WHERE turn IS DISTINCT FROM i + 1 UNION ALL SELECT seed_id, 'unknown_role' FROM e WHERE role IS NULL OR role NOT IN ('customer', 'assistant')
UNION ALL SELECT seed_id, CASE WHEN i = 0 THEN 'first_role' ELSE 'role_alternation' END FROM e WHERE role IN ('customer', 'assistant') AND role <> want)"""


@register("l1_turn_issues", _TURNS + " SELECT seed_id, code, count(*) AS n FROM x GROUP BY ALL")
def l1(spark, d):
    i = F.explode(validate.turn_issues(F.col("messages"), ["customer", "assistant"])).alias("i")
    return table(spark, d, "seed_conversations").select("seed_id", i).groupBy("seed_id", F.col("i.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


_LEVELS = ["Remember", "Understand", "Apply", "Analyze", "Evaluate", "Create"]


@register("l1_schema_issues", f"""WITH x AS (SELECT seed_id, 'schema_required' AS code, 'question' AS path FROM seed_questions WHERE question IS NULL UNION ALL SELECT seed_id, 'schema_required', 'response' FROM seed_questions WHERE response IS NULL
UNION ALL SELECT seed_id, 'schema_enum', 'bloom_level' FROM seed_questions WHERE bloom_level NOT IN ({', '.join(f"'{v}'" for v in _LEVELS)}) UNION ALL SELECT seed_id, 'schema_minLength', 'response' FROM seed_questions WHERE length(response) < 1) SELECT * FROM x""")
def l1s(spark, d):
    i = validate.schema_issues(["question", "response"], {"bloom_level": _LEVELS}, {"response": 1})
    return table(spark, d, "seed_questions").select("seed_id", F.explode(i).alias("i")).select("seed_id", "i.code", "i.path")


@register("l2_keyword_issues", """SELECT seed_id, 'advice:' || k AS code FROM (SELECT seed_id, array_to_string(list_transform(messages, lambda m: m.content), chr(10)) AS t FROM seed_conversations WHERE label = 'false'), (VALUES ('i''d suggest'), ('you should')) v(k) WHERE contains(lower(t), k)""")
def l2(spark, d):
    t = F.array_join(F.transform("messages", lambda m: m["content"]), "\n")
    i = validate.keyword_issues(t, "advice", forbidden=["i'd suggest", "you should"], when=validate.matches_when({"label": "false"}))
    return table(spark, d, "seed_conversations").select("seed_id", F.explode(i).alias("i")).select("seed_id", F.col("i.code").alias("code"))


@register("p10_escalated", "SELECT seed_id FROM seed_conversations WHERE coalesce(lower(difficulty) = 'hard', false) OR coalesce(contestable, false)")
def p10(spark, d):
    return table(spark, d, "seed_conversations").filter(validate.escalates()).select("seed_id")


# ---------------------------------------------------------------------------- votes and calibration

_MAJORITY = """WITH c AS (SELECT record_id, vote, count(vote) AS votes, min(ballot_no) AS first FROM ballots GROUP BY ALL), b AS (SELECT record_id, vote AS value, votes FROM c WHERE vote IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY votes DESC, first, vote) = 1),
t AS (SELECT record_id, count(vote) AS cast_votes, count(*) AS total FROM ballots GROUP BY 1), m AS (SELECT record_id, value, coalesce(votes, 0)::BIGINT AS votes, cast_votes, total, coalesce(votes * 2 > cast_votes, false) AS has_majority FROM t LEFT JOIN b USING (record_id))"""


@register("a20_majority", _MAJORITY + " SELECT * FROM m")
def a20(spark, d):
    return judging.majority(table(spark, d, "ballots"))


@register("l6_consistency", _MAJORITY + """ SELECT record_id, CASE WHEN cast_votes = 0 THEN 'consistency_no_votes' WHEN NOT has_majority THEN 'consistency_no_majority' WHEN value <> answer THEN 'consistency_answer_mismatch' END AS code FROM m LEFT JOIN seed_questions q ON q.seed_id = record_id""")
def l6(spark, d):
    return judging.consistency(table(spark, d, "ballots"), table(spark, d, "seed_questions").select(F.col("seed_id").alias("record_id"), "answer"))


@register("a22_vote_spread", """WITH p AS (SELECT record_id, count(vote) AS n, min(vote) AS lo, max(vote) AS hi FROM ballots GROUP BY 1 HAVING count(vote) > 1)
SELECT count(*) AS voted, count(*) FILTER (lo = hi) AS identical, round(count(*) FILTER (lo = hi) / count(*), 6) AS identical_share, count(*) >= 3 AND count(*) = count(*) FILTER (lo = hi) AS warns FROM p""")
def a22(spark, d):
    return judging.vote_spread(table(spark, d, "ballots")).withColumn("identical_share", F.round("identical_share", 6))


def _raters(spark, d):
    return table(spark, d, "abuse_labels").filter("rater_a is not null and rater_b is not null").select(F.col("rater_a").alias("judged"), F.col("rater_b").alias("human"))


@register("a15_kappa", """WITH p AS (SELECT rater_a AS a, rater_b AS b FROM abuse_labels WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL), x AS (SELECT a AS l, count(*) AS n FROM p GROUP BY 1), y AS (SELECT b AS l, count(*) AS n FROM p GROUP BY 1), s AS (SELECT sum(x.n * y.n) AS s FROM x JOIN y USING (l)), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS o FROM p)
SELECT n, o AS agreed, round((o * n - s) / nullif(n * n - s, 0), 6) AS kappa FROM t, s""")
def a15(spark, d):
    return judging.kappa(_raters(spark, d)).withColumn("kappa", F.round("kappa", 6))


@register("a18_confusion", "SELECT rater_a AS judged, rater_b AS human, count(*) AS n FROM abuse_labels WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL GROUP BY ALL")
def a18(spark, d):
    return judging.confusion(_raters(spark, d))


def _judged(spark, d):
    m = judging.majority(table(spark, d, "ballots")).filter("cast_votes > 0")
    q = table(spark, d, "seed_questions").filter("answer is not null").select(F.col("seed_id").alias("record_id"), "answer")
    return m.join(q, "record_id").select((F.col("votes") / F.col("cast_votes")).alias("confidence"), (F.col("value") == F.col("answer")).alias("correct"))


_BINS = _MAJORITY + """, j AS (SELECT votes / cast_votes AS confidence, (value = answer)::INT AS ok FROM m JOIN seed_questions q ON q.seed_id = record_id WHERE cast_votes > 0 AND answer IS NOT NULL),
bins AS (SELECT least(floor(confidence * 10), 9)::INT AS bin, count(*) AS n, avg(confidence) AS confidence, avg(ok) AS accuracy FROM j GROUP BY 1)"""


@register("a16_reliability_bins", _BINS + " SELECT r.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM range(10) r(bin) LEFT JOIN bins b ON b.bin = r.bin")
def a16(spark, d):
    return judging.reliability_bins(_judged(spark, d)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@register("a17_ece", _BINS + " SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM bins")
def a17(spark, d):
    return judging.expected_calibration_error(judging.reliability_bins(_judged(spark, d))).select(F.round("ece", 6).alias("ece"))


@register("a10_residuals", "SELECT rater_a AS judged, round(1 - count(*) FILTER (rater_a = rater_b) / count(*), 6) AS residual FROM abuse_labels WHERE rater_a IS NOT NULL AND rater_b IS NOT NULL GROUP BY 1")
def a10(spark, d):
    return judging.residual_by_label(judging.confusion(_raters(spark, d))).select("judged", F.round("residual", 6).alias("residual"))


# ---------------------------------------------------------------------------- planning


@register("j1_cross_axes", """WITH v AS (SELECT DISTINCT task, p.key AS axis, p.value AS value FROM (SELECT task, unnest(map_entries(params)) AS p FROM coverage_cells)), o AS (SELECT *, row_number() OVER (PARTITION BY task, axis ORDER BY value) - 1 AS o, count(*) OVER (PARTITION BY task, axis) AS n FROM v),
c AS (SELECT a.task, a.value || '|' || b.value AS cell_id, a.o * b.n + b.o AS pos, 1.0 / a.n / b.n AS share FROM o a JOIN o b ON a.task = 'cfa' AND b.task = 'cfa' AND a.axis = 'bloom_level' AND b.axis = 'keyword'
UNION ALL SELECT a.task, a.value || '|' || b.value || '|' || e.value, (a.o * b.n + b.o) * e.n + e.o, 1.0 / a.n / b.n / e.n FROM o a JOIN o b ON a.task = 'fag' AND b.task = 'fag' AND a.axis = 'conversation_length' AND b.axis = 'label' JOIN o e ON e.task = 'fag' AND e.axis = 'product_scope')
SELECT task, cell_id, pos::INT AS pos, round(share, 9) AS share FROM c""")
def j1(spark, d):
    """All combinations of the values that the cells of each task have, axes and values in order of name."""
    found: dict[str, dict[str, list[str]]] = {}
    values = table(spark, d, "coverage_cells").select("task", F.explode("params").alias("axis", "value")).distinct()
    for r in values.orderBy("task", "axis", "value").collect():  # a plan's axes are short
        found.setdefault(r["task"], {}).setdefault(r["axis"], []).append(r["value"])
    parts = [planning.cross(spark, [planning.Axis(a, v) for a, v in axes.items()]).select(F.lit(t).alias("task"), "cell_id", "pos", F.round("share", 9).alias("share")) for t, axes in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("w1_apportioned", """WITH x AS (SELECT cell_id, task, share / sum(share) OVER (PARTITION BY task) * 1000 AS e FROM coverage_cells), f AS (SELECT *, floor(round(e, 9)) AS f FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY round(e - f, 9) DESC, cell_id) AS r, 1000 - sum(f) OVER (PARTITION BY task) AS left_over FROM f)
SELECT task, cell_id, (f + (r <= left_over)::INT)::BIGINT AS apportioned FROM r""")
def w1(spark, d):
    cells = table(spark, d, "coverage_cells").select("task", "cell_id", "share")
    return planning.apportion(cells, 1000, order="cell_id", by=["task"]).select("task", "cell_id", F.col("quota").alias("apportioned"))


@register("w4_schedule", """WITH c AS (SELECT cell_id, quota, row_number() OVER (ORDER BY cell_id) AS pos FROM coverage_cells WHERE quota > 0), s AS (SELECT cell_id, quota, pos, unnest(range(quota)) AS i FROM c)
SELECT (row_number() OVER (ORDER BY i / quota, i - quota, pos) - 1)::BIGINT AS slot, cell_id, i::BIGINT AS i FROM s""")
def w4(spark, d):
    return planning.schedule(numbered(table(spark, d, "coverage_cells").filter("quota > 0").select("cell_id", "quota"), "cell_id", name="pos"))


@register("w7_candidate_seeds", """WITH s AS (SELECT cell_id, unnest(range(quota)) AS i FROM coverage_cells WHERE quota > 0) SELECT cell_id, i::BIGINT AS i, ('0x' || substring(sha256('7:' || cell_id || ':' || i), 1, 16))::UBIGINT::DECIMAL(20,0)::VARCHAR AS seed FROM s""")
def w7(spark, d):
    slots = planning.schedule(numbered(table(spark, d, "coverage_cells").filter("quota > 0").select("cell_id", "quota"), "cell_id", name="pos"))
    return planning.candidates(slots, 7).select("cell_id", "i", F.col("seed").cast("string").alias("seed"))


@register("a9_planned_targets", """WITH v AS (SELECT task, unnest(map_entries(params)) AS p, quota FROM coverage_cells), g AS (SELECT task, p.key AS axis, p.value AS value, sum(quota)::BIGINT AS quota FROM v GROUP BY ALL)
SELECT task, axis, value, quota, round(quota / nullif(sum(quota) OVER (PARTITION BY task, axis), 0), 6) AS target FROM g""")
def a9(spark, d):
    return metrics.planned_targets(table(spark, d, "coverage_cells"), ["task"]).withColumn("target", F.round("target", 6))


@register("a24_plan_labels", "SELECT params['bloom_level'] AS value, sum(quota)::BIGINT AS quota FROM coverage_cells GROUP BY 1")
def a24(spark, d):
    return planning.label_counts(table(spark, d, "coverage_cells"), "bloom_level")


@register("t4_sample")
def t4(spark, d):
    """A hundred questions drawn without replacement; held against the whole order of hashes in tests."""
    return planning.drawn(table(spark, d, "seed_questions").select("seed_id", "qa_key"), 100, "seed_id", seed="t4")


@register("w3_few_shot", """WITH x AS (SELECT seed_id, bloom_level, row_number() OVER (PARTITION BY bloom_level ORDER BY seed_id) AS depth, min(seed_id) OVER (PARTITION BY bloom_level) AS first FROM seed_questions WHERE bloom_level IS NOT NULL)
SELECT seed_id, bloom_level FROM x ORDER BY depth, first LIMIT 20""")
def w3(spark, d):
    q = table(spark, d, "seed_questions").filter("bloom_level is not null").select("seed_id", "bloom_level")
    return judging.interleave(q, "bloom_level", "seed_id", 20)


# ---------------------------------------------------------------------------- metrics

_TRIES = """WITH h AS (SELECT cell_id, CASE WHEN len(coalesce(history, [])) = coalesce(attempts, 0) THEN list_transform(history, lambda h: h.layer) ELSE list_transform(range(coalesce(attempts, 0)), lambda i: layer) END AS l FROM drops),
t AS (SELECT cell_id, unnest(l) AS layer FROM h UNION ALL SELECT cell_id, NULL FROM seed_questions)"""


def _tries(spark, d):
    ok = table(spark, d, "seed_questions").select("cell_id", F.lit(0).alias("repair_count"), F.array().cast("array<struct<attempt:int,layer:string>>").alias("failed"))
    return metrics.tries(ok, table(spark, d, "drops"))


@register("a5_error_rates", _TRIES + """, g AS (SELECT cell_id, grouping(cell_id) = 1 AS is_total, layer, count(*) AS failed FROM t GROUP BY GROUPING SETS ((layer), (cell_id, layer))), n AS (SELECT cell_id, grouping(cell_id) = 1 AS is_total, count(*) AS tries FROM t GROUP BY GROUPING SETS ((), (cell_id)))
SELECT g.cell_id, g.is_total, g.layer, g.failed, n.tries, round(g.failed / n.tries, 6) AS rate FROM g JOIN n ON g.cell_id IS NOT DISTINCT FROM n.cell_id AND g.is_total = n.is_total WHERE g.layer IS NOT NULL""")
def a5(spark, d):
    return metrics.error_rates(_tries(spark, d)).withColumn("rate", F.round("rate", 6))


@register("a6_yield", _TRIES + " SELECT (SELECT count(*) FROM seed_questions) AS accepted, count(*) AS tries, round((SELECT count(*) FROM seed_questions) / count(*), 6) AS yield FROM t")
def a6(spark, d):
    return metrics.yields(table(spark, d, "seed_questions"), _tries(spark, d)).withColumn("yield", F.round("yield", 6))


_COVER = """WITH h AS (SELECT cell_id, count(*) AS a FROM (SELECT cell_id FROM seed_questions UNION ALL SELECT cell_id FROM seed_conversations) GROUP BY 1), c AS (SELECT cell_id, quota, coalesce(a, 0)::BIGINT AS accepted, CASE WHEN quota = 0 THEN 1.0::DOUBLE ELSE coalesce(a, 0) / quota END AS fill, greatest(quota - coalesce(a, 0), 0)::BIGINT AS missing FROM coverage_cells LEFT JOIN h USING (cell_id))"""


def _cover(spark, d):
    """Coverage of all cells of both tasks by all records of both."""
    records = table(spark, d, "seed_questions").select("cell_id").unionByName(table(spark, d, "seed_conversations").select("cell_id"))
    return metrics.coverage(table(spark, d, "coverage_cells"), records)


@register("a7_coverage", _COVER + " SELECT cell_id, quota, accepted, round(fill, 6) AS fill, missing FROM c")
def a7(spark, d):
    return _cover(spark, d).withColumn("fill", F.round("fill", 6))


@register("a7_coverage_summary", _COVER + " SELECT round(sum(accepted) / sum(quota), 6) AS fill, round(avg((fill >= 1)::INT), 6) AS cells_at_quota, round(min(fill), 6) AS min_cell_fill, count(*) FILTER (missing > 0) AS short_cells FROM c")
def a7s(spark, d):
    s = metrics.coverage_summary(_cover(spark, d))
    return s.select(*[F.round(c, 6).alias(c) for c in ("fill", "cells_at_quota", "min_cell_fill")], "short_cells")


def _balance_sql(axis: str, records: str) -> str:
    return f"""SELECT '{axis}' AS axis, value, round(coalesce(target, 0.0), 6) AS target, round(coalesce(n, 0) / s, 6) AS actual, round(abs(coalesce(n, 0) / s - coalesce(target, 0.0)), 6) AS deviation FROM
(SELECT params['{axis}'] AS value, sum(quota) / (SELECT sum(quota) FROM coverage_cells WHERE params['{axis}'] IS NOT NULL) AS target FROM coverage_cells WHERE params['{axis}'] IS NOT NULL GROUP BY 1) FULL JOIN (SELECT {axis} AS value, count(*) AS n FROM {records} WHERE {axis} IS NOT NULL GROUP BY 1) USING (value), (SELECT count(*) AS s FROM {records} WHERE {axis} IS NOT NULL)"""


_BALANCED = {"bloom_level": "seed_questions", "keyword": "seed_questions", "label": "seed_conversations", "product_scope": "seed_conversations", "conversation_length": "seed_conversations"}


@register("a8_balance", " UNION ALL ".join(_balance_sql(a, t) for a, t in _BALANCED.items()))
def a8(spark, d):
    """Planned and actual shares of every axis of both tasks."""
    targets = metrics.planned_targets(table(spark, d, "coverage_cells"))
    parts = [metrics.balance(table(spark, d, t).select(F.col(axis).alias("value")), targets.filter(F.col("axis") == axis), axis) for axis, t in _BALANCED.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("axis", "value", *[F.round(c, 6).alias(c) for c in ("target", "actual", "deviation")])


@register("a23_drop_counts", """SELECT CASE WHEN grouping(cell_id) = 0 THEN 'cell_layer' ELSE 'layer' END AS level, cell_id, layer, NULL::VARCHAR AS code, count(*) AS n FROM drops GROUP BY GROUPING SETS ((cell_id, layer), (layer))
UNION ALL SELECT 'code', NULL, NULL, code, count(*) FROM (SELECT unnest(codes) AS code FROM drops) GROUP BY code""")
def a23(spark, d):
    return metrics.drop_counts(table(spark, d, "drops"))


# layer results of questions: every ballot is a judgement at the first attempt
_VOTED = """v AS (SELECT record_id, arg_max(coalesce(vote, ''), ballot_no) AS last FROM ballots GROUP BY 1), f AS (SELECT q.seed_id, q.cell_id, CASE WHEN v.record_id IS NULL THEN NULL ELSE coalesce(v.last = q.answer, false) END AS agreed FROM seed_questions q LEFT JOIN v ON v.record_id = q.seed_id)"""


def _accepted(spark, d):
    """Questions as accepted records: their ballots, in order, are the judge's results."""
    q = table(spark, d, "seed_questions").select(F.col("seed_id").alias("id"), "cell_id", F.col("response").alias("text"), F.col("bloom_level").alias("label"), "answer")
    b = table(spark, d, "ballots").select(F.col("record_id").alias("id"), F.col("ballot_no").alias("n"), F.coalesce("vote", F.lit("")).alias("v")).join(q.select("id", "answer"), "id")
    result = F.struct(F.col("n"), F.struct(F.lit("L5").alias("layer"), F.when(F.col("v") == F.col("answer"), "pass").otherwise("fail_repairable").alias("outcome"), F.lit(0).alias("attempt")).alias("r"))
    results = b.groupBy("id").agg(F.transform(F.array_sort(F.collect_set(result)), lambda x: x["r"]).alias("layer_results"))  # a record has few ballots
    return q.join(results, "id", "left").withColumns({"repair_count": F.lit(0), "layer_results": F.coalesce("layer_results", F.array().cast("array<struct<layer:string,outcome:string,attempt:int>>"))})


@register("w6_last_judgement", "WITH " + _VOTED + " SELECT seed_id, agreed FROM f")
def w6(spark, d):
    return _accepted(spark, d).select(F.col("id").alias("seed_id"), metrics.final_judgement(F.col("layer_results"), F.col("repair_count")).alias("agreed"))


@register("a4_fidelity", "WITH " + _VOTED + " SELECT cell_id, grouping(cell_id) = 1 AS is_total, count(agreed) AS judged, round(avg(agreed::INT), 6) AS fidelity FROM f GROUP BY GROUPING SETS ((), (cell_id))")
def a4(spark, d):
    judged = _accepted(spark, d).select("cell_id", metrics.final_judgement(F.col("layer_results"), F.col("repair_count")).alias("agreed"))
    return metrics.fidelity_by_cell(judged).withColumn("fidelity", F.round("fidelity", 6)).select("cell_id", "is_total", "judged", "fidelity")


_FLAGGED = "m AS (SELECT seed_id AS id, cell_id, unnest(messages).content AS t FROM seed_conversations), t AS (" + " UNION ALL ".join(_tox_sql(c).replace("SELECT id,", "SELECT id, cell_id,") for c in S.TOXICITY) + ")"


def _flags(spark, d):
    """Toxic categories of every conversation's messages, one code per message and category."""
    hits = lambda m: F.array_compact(F.array(*[F.when(S.has(m["content"], S.toxicity_pattern(c)), F.lit(f"toxicity_{c}")) for c in S.TOXICITY]))
    return table(spark, d, "seed_conversations").select("cell_id", F.coalesce(F.flatten(F.transform("messages", hits)), F.array().cast("array<string>")).alias("codes"))


@register("a11_governance_violations", "WITH " + _FLAGGED + ", x AS (SELECT DISTINCT id FROM t) SELECT cell_id, grouping(cell_id) = 1 AS is_total, count(x.id) AS violations FROM seed_conversations c LEFT JOIN x ON x.id = c.seed_id GROUP BY GROUPING SETS ((), (cell_id))")
def a11(spark, d):
    return metrics.governance_counts(_flags(spark, d)).select("cell_id", "is_total", "violations")


@register("a11_governance_codes", "WITH " + _FLAGGED + " SELECT cell_id, grouping(cell_id) = 1 AS is_total, 'toxicity_' || category AS code, count(*) AS n FROM t GROUP BY GROUPING SETS ((category), (cell_id, category))")
def a11c(spark, d):
    return metrics.governance_codes(_flags(spark, d))


def _sets_sql(source: str) -> str:
    return f"(SELECT id, unnest(s) AS g, len(s) AS n FROM (SELECT id, CASE WHEN t = '' THEN [] WHEN len(l) <= 5 THEN [t] ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: l[i] || l[i+1] || l[i+2] || l[i+3] || l[i+4])) END AS s FROM (SELECT id, t, string_split(t, '') AS l FROM (SELECT id, {norm('t')} AS t FROM ({source}) WHERE t IS NOT NULL))))"


_OVERLAPS = f"""q AS {_sets_sql('SELECT seed_id AS id, question AS t FROM seed_questions')}, h AS {_sets_sql('SELECT item_id AS id, text AS t FROM held_out')}, e AS {_sets_sql('SELECT label_id AS id, text AS t FROM abuse_labels')},
best AS (SELECT 'held_out' AS source, id, max(score) AS score FROM (SELECT q.id AS id, h.id AS i, count(*) / (any_value(q.n) + any_value(h.n) - count(*)) AS score FROM q JOIN h USING (g) GROUP BY ALL) GROUP BY id UNION ALL SELECT 'seed', id, max(score) FROM (SELECT q.id AS id, e.id AS i, count(*) / (any_value(q.n) + any_value(e.n) - count(*)) AS score FROM q JOIN e USING (g) GROUP BY ALL) GROUP BY id)"""


def _overlaps(spark, d):
    """Best matches of every question among held-out items, and among the labelled texts in place of seeds."""
    q = table(spark, d, "seed_questions").select(F.col("seed_id").alias("id"), F.col("question").alias("text"))
    return overlap.overlap_layer(q, table(spark, d, "held_out"), table(spark, d, "abuse_labels").select(F.col("label_id").alias("item_id"), "text"))


@register("l4_overlap", f"WITH {_OVERLAPS} SELECT id, source, round(score, 6) AS score, CASE WHEN score > 0.8 THEN source || '_overlap' END AS code FROM best")
def l4(spark, d):
    return _overlaps(spark, d).select("id", "source", F.round("score", 6).alias("score"), "code")


@register("a12_overlap_max", f"WITH {_OVERLAPS} SELECT cell_id, grouping(cell_id) = 1 AS is_total, source, round(max(score), 6) AS overlap FROM best JOIN seed_questions s ON s.seed_id = best.id GROUP BY GROUPING SETS ((source), (cell_id, source))")
def a12(spark, d):
    """Highest similarity by source, overall and per cell."""
    cells = table(spark, d, "seed_questions").select(F.col("seed_id").alias("id"), "cell_id")
    return metrics.overlap_maxima(_overlaps(spark, d).join(cells, "id")).withColumn("overlap", F.round("overlap", 6))


_USAGE = "u AS (SELECT stage, ceil(coalesce(length(q.question), 0) / 4.0)::BIGINT AS i, ceil(coalesce(length(vote), 0) / 4.0)::BIGINT AS o, CASE WHEN model LIKE '%a%' THEN (ceil(coalesce(length(q.question), 0) / 4.0) * 4.0 + ceil(coalesce(length(vote), 0) / 4.0) * 20.0) / 1e6 END AS cost FROM ballots b LEFT JOIN seed_questions q ON q.seed_id = b.record_id)"


def _usage(spark, d):
    """A call per ballot: tokens of question and vote, priced for models with an a in their name, unpriced for others."""
    q = table(spark, d, "seed_questions").select(F.col("seed_id").alias("record_id"), "question")
    tokens_in, tokens_out = (T.token_estimate(F.coalesce(c, F.lit(""))) for c in ("question", "vote"))
    b = table(spark, d, "ballots").join(q, "record_id", "left")
    return b.select("stage", F.lit(1).alias("calls"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"), F.when(F.col("model").contains("a"), T.cost(tokens_in, tokens_out, 4.0, 20.0)).alias("cost"))


@register("a14_usage", f"WITH {_USAGE} SELECT stage, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, round(sum(cost), 6) AS cost FROM u GROUP BY stage")
def a14(spark, d):
    return metrics.usage_totals(_usage(spark, d)).withColumn("cost", F.round("cost", 6))


@register("a13_per_record", f"WITH {_USAGE}, n AS (SELECT count(*) AS n FROM seed_questions) SELECT round(sum(i + o) / any_value(n), 6) AS tokens_per_record, round(sum(cost) / any_value(n), 9) AS cost_per_record FROM u, n")
def a13(spark, d):
    u = metrics.usage_totals(_usage(spark, d)).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost").alias("cost"))
    n = table(spark, d, "seed_questions").agg(F.count(F.lit(1)).alias("n"))
    return u.crossJoin(F.broadcast(n)).select(F.round(metrics.per_record(F.col("tokens"), F.col("n")), 6).alias("tokens_per_record"), F.round(metrics.per_record(F.col("cost"), F.col("n")), 9).alias("cost_per_record"))


@register("a21_vote_agreement", """WITH v AS (SELECT b.record_id, count(*) FILTER (vote = answer) AS agree, count(vote) AS cast_votes FROM ballots b LEFT JOIN seed_questions q ON q.seed_id = b.record_id GROUP BY 1)
SELECT record_id, agree, cast_votes, agree * 2 > cast_votes AS agrees, CASE WHEN cast_votes = 0 THEN 'consistency_no_votes' WHEN agree * 2 <= cast_votes THEN 'consistency_disagrees' END AS code FROM v""")
def a21(spark, d):
    return judging.vote_agreement(table(spark, d, "ballots"), table(spark, d, "seed_questions").select(F.col("seed_id").alias("record_id"), F.col("answer").alias("label")))


_REPORT = "WITH " + _VOTED + """, t AS (SELECT cell_id, unnest(CASE WHEN len(coalesce(history, [])) = coalesce(attempts, 0) THEN list_transform(history, lambda h: h.layer) ELSE list_transform(range(coalesce(attempts, 0)), lambda i: layer) END) AS layer FROM drops UNION ALL SELECT cell_id, NULL FROM seed_questions),
known AS (SELECT f.* FROM f WHERE cell_id IN (SELECT cell_id FROM coverage_cells)), tk AS (SELECT t.* FROM t WHERE cell_id IN (SELECT cell_id FROM coverage_cells)),
n AS (SELECT cell_id, count(*) AS accepted, count(agreed) AS judged, avg(agreed::INT) AS fidelity FROM known GROUP BY 1), y AS (SELECT cell_id, count(*) AS candidates FROM tk GROUP BY 1),
c AS (SELECT c.cell_id, c.quota, coalesce(n.accepted, 0) AS accepted, coalesce(judged, 0) AS judged, fidelity, coalesce(candidates, 0) AS candidates, CASE WHEN c.quota = 0 THEN 1.0::DOUBLE ELSE coalesce(n.accepted, 0) / c.quota END AS fill FROM coverage_cells c LEFT JOIN n USING (cell_id) LEFT JOIN y USING (cell_id)),
r AS (SELECT cell_id, false AS is_total, accepted, judged, fidelity, candidates, quota, fill, fill AS min_cell_fill, NULL::DOUBLE AS cells_at_quota, (quota > accepted)::BIGINT AS short_cells FROM c
UNION ALL SELECT NULL, true, sum(accepted), sum(judged), (SELECT avg(agreed::INT) FROM known), sum(candidates), sum(quota), sum(accepted) / sum(quota), min(fill), avg((fill >= 1)::INT), count(*) FILTER (quota > accepted) FROM c)"""


def _report(spark, d):
    """The metrics report over the questions of the plan's cells, with their drops."""
    cells = table(spark, d, "coverage_cells")
    ok = _accepted(spark, d).join(F.broadcast(cells.select("cell_id")), "cell_id", "left_semi")
    drops = table(spark, d, "drops").join(F.broadcast(cells.select("cell_id")), "cell_id", "left_semi")
    return metrics.report(ok, drops, cells, targets={}, with_diversity=False)  # no column of these queries needs it


@register("a27_report", _REPORT + " SELECT cell_id, is_total, accepted::BIGINT AS accepted, judged::BIGINT AS judged, round(fidelity, 6) AS fidelity, candidates::BIGINT AS candidates, round(accepted / nullif(candidates, 0), 6) AS yield, quota::BIGINT AS quota, round(fill, 6) AS fill, round(min_cell_fill, 6) AS min_cell_fill, round(cells_at_quota, 6) AS cells_at_quota, short_cells FROM r")
def a27(spark, d):
    rounded = [F.round(c, 6).alias(c) for c in ("fidelity", "yield", "fill", "min_cell_fill", "cells_at_quota")]
    return _report(spark, d).select("cell_id", "is_total", "accepted", "judged", "candidates", "quota", "short_cells", *rounded)


_LIMITS = {"fidelity_min": 0.95, "kappa_min": 0.7, "coverage_min_cell_fill": 0.9, "balance_tolerance": 0.05, "residual_error_max": 0.05, "cost_per_record_max": 0.05}


@register("d14_gate", _REPORT + f""", l AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v}::DOUBLE)" for k, v in (_LIMITS | {'governance_violations_max': 0.0}).items())}) t(metric, threshold)),
w AS (SELECT r.cell_id, l.metric, l.threshold, CASE l.metric WHEN 'fidelity_min' THEN r.fidelity WHEN 'coverage_min_cell_fill' THEN r.min_cell_fill END AS value FROM r CROSS JOIN l WHERE r.is_total OR l.metric IN ('fidelity_min', 'coverage_min_cell_fill', 'balance_tolerance', 'residual_error_max', 'governance_violations_max')),
x AS (SELECT *, CASE WHEN metric = 'governance_violations_max' THEN 'governance' WHEN value IS NULL THEN CASE WHEN cell_id IS NULL AND metric <> 'kappa_min' THEN 'not_measured' END WHEN value < threshold THEN 'below_min' END AS reason FROM w)
SELECT cell_id, metric, round(value, 6) AS value, threshold, reason FROM x WHERE reason IS NOT NULL""")
def d14(spark, d):
    """The gate over the report, kappa waived as nobody measured it."""
    values = metrics.gate_values(_report(spark, d))
    return metrics.gate(values, _LIMITS, waive=("kappa_min",)).withColumn("value", F.round("value", 6))


_PLAIN = "[^\\p{L}\\p{N}_]"
_CASCADE = f"""WITH {_OVERLAPS}, {_MAJORITY[5:]}, o AS (SELECT *, list_distinct(regexp_extract_all(question, '(?m)^\\s*\\(?([A-D])[).:]\\s', 1)) AS labels, coalesce(nullif(regexp_extract(response, '[Aa]nswer:\\s*([A-D])', 1), ''), nullif(regexp_extract(response, '(?:^|{_PLAIN})([A-D])(?:$|{_PLAIN})', 1), '')) AS found FROM seed_questions),
x AS (SELECT seed_id, CASE WHEN question IS NULL OR response IS NULL OR length(question) < 1 OR length(response) < 1 THEN 'L1'
WHEN response IS NOT NULL AND (found IS NULL OR (answer IS NOT NULL AND answer <> found)) THEN 'L1' WHEN len(labels) < 2 OR (coalesce(nullif(answer, ''), found) IS NOT NULL AND NOT list_contains(labels, coalesce(nullif(answer, ''), found))) THEN 'L1'
WHEN regexp_matches(question || chr(10) || response, '(?i)guaranteed') OR bloom_level IS NULL THEN 'L2'
WHEN {' OR '.join(f"regexp_matches(response, '(?i)(?:^|[^{chr(92)}p{{L}}{chr(92)}p{{N}}_{chr(39)*2}])(?:{'|'.join(f'(?:{r})' for r in S.TOXICITY[c]).replace(chr(39), chr(39)*2)})(?:$|{_PLAIN})')" for c in S.TOXICITY)} THEN 'L3'
WHEN EXISTS (SELECT 1 FROM best WHERE best.id = o.seed_id AND best.source = 'held_out' AND score > 0.8) THEN 'L4'
WHEN EXISTS (SELECT 1 FROM (SELECT record_id, arg_min(coalesce(vote, ''), ballot_no) AS v FROM ballots GROUP BY 1) j WHERE j.record_id = o.seed_id AND (v = '' OR NOT coalesce(v = o.answer, false))) THEN 'L5'
WHEN EXISTS (SELECT 1 FROM m WHERE m.record_id = o.seed_id AND (cast_votes = 0 OR NOT has_majority OR coalesce(value <> o.answer, false))) THEN 'L6' END AS layer FROM o)
SELECT layer, count(*) AS n FROM x GROUP BY layer"""


def _cascade(spark, d):
    """All six layers over every question: schema, answers and options; a keyword rule and a label rule; toxic words; overlap
    with held-out items; the first ballot as judge; the majority of all ballots."""
    q = table(spark, d, "seed_questions").withColumnRenamed("seed_id", "id")
    schema = {"required": ["question", "response"], "properties": {"question": {"type": "string", "minLength": 1}, "response": {"type": "string", "minLength": 1}}}
    l1 = validate.first_of(validate.json_schema_issues(schema, q.schema), F.concat(validate.answer_issues(F.col("response"), F.col("answer"), T.choice_answer), validate.option_issues(F.col("question"), F.col("response"), F.col("answer"))))
    l2 = F.concat(validate.rule_issues({"kind": "forbidden", "keywords": ["guaranteed"], "fields": ["question", "response"]}), validate.label_issues(F.col("bloom_level"), F.col("bloom_level")))
    scanner = governance.RuleScanner("toxicity", {c: S.toxicity_pattern(c) for c in S.TOXICITY}, "keywords")
    l3 = validate.governance_issues(F.array(F.struct(F.col("response").alias("content"))), scanner)
    answers = q.select("id", F.col("answer").alias("label"))
    first = table(spark, d, "ballots").groupBy(F.col("record_id").alias("id")).agg(F.min_by(F.coalesce("vote", F.lit("")), "ballot_no").alias("v"))
    judged = first.join(answers, "id").select("id", F.nullif("v", F.lit("")).alias("verdict"), "label", F.lit(1.0).alias("confidence"))
    votes = judging.consistency(table(spark, d, "ballots"), table(spark, d, "seed_questions").select(F.col("seed_id").alias("record_id"), "answer")).withColumnRenamed("record_id", "id")
    l4 = validate.overlap_issues(table(spark, d, "held_out"), text_of=F.col("question"))
    return validate.run_cascade(q, [validate.Layer("L1", l1), validate.Layer("L2", l2), validate.Layer("L3", l3), validate.Layer("L4", l4), validate.Layer("L5", validate.judge_issues(judged)), validate.Layer("L6", validate.vote_issues(votes))])


@register("l_cascade", _CASCADE)
def lc(spark, d):
    return _cascade(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@register("k9_endpoints", "SELECT DISTINCT model FROM ballots WHERE model IS NOT NULL")
def k9(spark, d):
    b = table(spark, d, "ballots").select("model", "stage")
    return store.endpoints(b.filter("stage = 'judge'").select("model"), b.filter("stage is null or stage <> 'judge'").select("model"))


@register("k10_tool_rollup", "SELECT layer AS tool, count(*) AS calls, list_sort(list_distinct(list(CASE WHEN hard THEN 'hard' WHEN NOT hard THEN 'soft' END) FILTER (hard IS NOT NULL)))::VARCHAR AS sensitivities FROM drops GROUP BY layer")
def k10(spark, d):
    """The roll-up of calls and sensitivities, over drops as traces: layers as tools."""
    traces = table(spark, d, "drops").select(F.col("layer").alias("tool"), F.when(F.col("hard"), "hard").when(~F.col("hard"), "soft").alias("sensitivity"))
    r = store.tool_rollup(traces)
    return r.select("tool", "calls", F.concat(F.lit("["), F.array_join("sensitivities", ", "), F.lit("]")).alias("sensitivities"))


@register("s7_review_items", "SELECT sha256(question) AS item_id, min(seed_id) AS n FROM seed_questions WHERE question IS NOT NULL GROUP BY 1")
def s7(spark, d):
    return store.queue_items(table(spark, d, "seed_questions").filter("question is not null").select(F.col("seed_id").alias("n"), F.col("question").alias("content"))).select("item_id", "n")
