"""The pN_ queries: (spark, folder) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.matching import category_key
from granary.llm import p1_leaks, p2_neardup, p3_sample, p4_personal, p5_abuse, p6_pairs, p7_pack, p8_mix, p9_sentences
from granary.session import staged
from granary.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sample(spark, d):
    tables = {"seed_conversations": (table(spark, d, "seed_conversations"), "conversation_id"), "seed_questions": (table(spark, d, "seed_questions"), "qa_key")}
    return p3_sample.sample_to_targets(tables, table(spark, d, "sample_targets"))


@query
def p3_found(spark, d):
    """Categories whose target or minimum can't be met."""
    return _sample(spark, d).report.filter("unmet").select("plan_id", "category")


@query
def p3_report(spark, d):
    """Seats, shares and shortfalls of every plan's categories."""
    return _sample(spark, d).report


@query
def p3_sample_rows(spark, d):
    """The sampled records with rank, floor flag and priority."""
    return _sample(spark, d).rows


@query
def p7_found(spark, d):
    """Documents that had to be split, by pack."""
    rows = p7_pack.pack(table(spark, d, "documents"), table(spark, d, "containers")).rows
    return rows.filter("pieces > 1").select("pack_id", "doc_id").distinct()


@query
def p7_assignment(spark, d):
    """Container of every document piece."""
    return p7_pack.pack(table(spark, d, "documents"), table(spark, d, "containers")).rows


@query
def p7_fill(spark, d):
    """Fill of every container."""
    return p7_pack.pack(table(spark, d, "documents"), table(spark, d, "containers")).fill


@query
def p8_found(spark, d):
    """Sources that fall short of their weight even when repeated as often as allowed."""
    return p8_mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).report.filter("is_short").select("mix_id", "source")


@query
def p8_report(spark, d):
    """Target and actual tokens and shares by mix and source."""
    return p8_mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


@query
def p8_mix_rows(spark, d):
    """Documents of each mix with their number of copies."""
    return p8_mix.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets")).rows


#: Codes (places) of tables in operators that compare records within a table.
TABLES = ["seed_conversations", "seed_questions", "documents"]


def conversation_text():
    """Non-null contents in turn order, joined by a line break."""
    turns = F.array_sort(F.transform("messages", lambda m, i: F.struct(m["turn"].alias("turn"), i.alias("i"), m["content"].alias("content"))))
    return F.array_join(F.transform(F.filter(turns, lambda m: m["content"].isNotNull()), lambda m: m["content"]), "\n")


def _name(code="tbl"):
    return F.element_at(F.array(*[F.lit(t) for t in TABLES]), F.col(code).cast("int") + 1).alias("tbl")


def _near(spark, d):
    c = table(spark, d, "seed_conversations").select(F.lit(0).cast("tinyint").alias("tbl"), F.col("seed_id").alias("id"), conversation_text().alias("text"))
    q = table(spark, d, "seed_questions").select(F.lit(1).cast("tinyint").alias("tbl"), F.col("seed_id").alias("id"), F.col("question").alias("text"))
    return p2_neardup.NearDuplicates(c.unionByName(q))


@query
def p2_found(spark, d):
    """Pairs of nearly equal records of one table."""
    return _near(spark, d).pairs().select(_name(), "id_a", "id_b")


@query
def p2_groups(spark, d):
    """Group and number of links of every record."""
    return _near(spark, d).all_groups().select(_name(), "id", "group_id", "links")


@query
def p6_found(spark, d):
    """Broken pairs with their defect."""
    return p6_pairs.find_defects(table(spark, d, "seed_questions"))


@query
def p9_found(spark, d):
    """Sentence units of every document."""
    return p9_sentences.split_sentences(table(spark, d, "documents"))


def messages(spark, d):
    """tbl, rec_id, turn, text of every message."""
    return table(spark, d, "seed_conversations").select(F.lit("seed_conversations").alias("tbl"), F.col("seed_id").alias("rec_id"), F.explode("messages").alias("m")).select("tbl", "rec_id", F.col("m.turn").alias("turn"), F.col("m.content").alias("text"))


#: The key of the registered queries, which run on invented data; a deployment passes its own secret.
TEST_KEY = b"granary test key"


def _personal_texts(spark, d):
    q = table(spark, d, "seed_questions").select(F.lit("seed_questions").alias("tbl"), F.col("seed_id").alias("rec_id"), F.lit(0).alias("turn"), F.col("question").alias("text"))
    return messages(spark, d).unionByName(q)


@query
def p4_found(spark, d):
    """Place and kind of every piece of personal data."""
    return p4_personal.find_personal(_personal_texts(spark, d), table(spark, d, "given_names"), TEST_KEY).drop("pseudonym")


@query
def p4_redacted(spark, d):
    """Every text with typed placeholders."""
    return p4_personal.redact_personal(_personal_texts(spark, d), table(spark, d, "given_names"), TEST_KEY)


def _abuse_texts(spark, d):
    m = messages(spark, d).select("tbl", "rec_id", "text")
    q = table(spark, d, "seed_questions").select(F.lit("seed_questions").alias("tbl"), F.col("seed_id").alias("rec_id"), F.col("response").alias("text"))
    return m.unionByName(q).unionByName(table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text"))


def _abuse(spark, d):
    texts = _abuse_texts(spark, d)
    read = staged(p5_abuse.read_texts(texts), "words")
    return read, p5_abuse.fit_on(table(spark, d, "abuse_labels"), texts, read)


@query
def p5_found(spark, d):
    """Records with an abusive, threatening, hateful or sexually explicit remark."""
    texts, net = _abuse(spark, d)
    return p5_abuse.score_records(texts, net).filter("abusive").select("tbl", "rec_id")


@query
def p5_scores(spark, d):
    """Score of every record."""
    texts, net = _abuse(spark, d)
    return p5_abuse.score_records(texts, net)


@query
def p5_rates(spark, d):
    """Records, abusive records and rate by table and source: documents by their source under its normal spelling, other
    tables under their own name."""
    texts, net = _abuse(spark, d)
    source = table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), category_key(F.col("source")).alias("source"))
    per = p5_abuse.score_records(texts, net).join(source, ["tbl", "rec_id"], "left").withColumn("source", F.when(F.col("tbl") == "documents", F.col("source")).otherwise(F.col("tbl")))
    return per.groupBy("tbl", "source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("abusive").cast("bigint")).alias("abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"))


def _leaks(spark, d):
    q = table(spark, d, "seed_questions").select(F.lit("seed_questions").alias("tbl"), F.col("seed_id").alias("rec_id"), F.col("question").alias("text"))
    t = table(spark, d, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "text")
    return p1_leaks.find_leaks(messages(spark, d).select("tbl", "rec_id", "text").unionByName(q).unionByName(t), table(spark, d, "held_out"))


@query
def p1_found(spark, d):
    """Records that contain held-out items."""
    return _leaks(spark, d).select("tbl", "rec_id", "item_id").distinct()


@query
def p1_matches(spark, d):
    """Leaks with cosine, share of words and whether the answer is given away."""
    return _leaks(spark, d)
