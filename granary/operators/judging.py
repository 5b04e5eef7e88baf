"""Votes and calibration of judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(ballots: DataFrame, key: str = "record_id", vote: str = "vote", order: str = "ballot_no") -> DataFrame:
    """``key, value, votes, cast_votes, total, has_majority``: the most frequent non-null vote of each key, ties to the vote first cast.

    Null votes are abstentions and count in neither; a majority is strictly more than half of the votes cast. Keys with
    abstentions only have a null value. Votes are counted by key and value before the ranking.
    """
    counts = ballots.groupBy(key, vote).agg(F.count(vote).alias("votes"), F.min(order).alias("first"), F.count(F.lit(1)).alias("rows"))
    best = F.min(F.when(F.col(vote).isNotNull(), F.struct((-F.col("votes")).alias("n"), F.col("first"), F.col(vote).alias("value"))))
    out = counts.groupBy(key).agg(best.alias("b"), F.sum("votes").alias("cast_votes"), F.sum("rows").alias("total"))
    return out.select(key, F.col("b.value").alias("value"), F.coalesce(-F.col("b.n"), F.lit(0)).alias("votes"), "cast_votes", "total", F.coalesce(-F.col("b.n") * 2 > F.col("cast_votes"), F.lit(False)).alias("has_majority"))


def consistency(ballots: DataFrame, answers: DataFrame, key: str = "record_id") -> DataFrame:
    """``key, code``: ``consistency_no_votes`` (hard), ``consistency_no_majority``, ``consistency_answer_mismatch`` or null, of each voted key.

    ``answers``: key, answer. A null answer can't mismatch."""
    code = F.when(F.col("cast_votes") == 0, "consistency_no_votes").when(~F.col("has_majority"), "consistency_no_majority").when(F.col("value") != F.col("answer"), "consistency_answer_mismatch")
    return majority(ballots, key).join(answers, key, "left").select(key, code.alias("code"))


def vote_spread(ballots: DataFrame, key: str = "record_id", vote: str = "vote", warn_at: int = 3) -> DataFrame:
    """``voted, identical, identical_share, warns``: keys with more than one vote, how many of them voted alike; warns where
    there are at least ``warn_at`` and all are identical. One row; a null share where nothing was voted on."""
    per = ballots.groupBy(key).agg(F.count(vote).alias("n"), F.min(vote).alias("lo"), F.max(vote).alias("hi")).filter("n > 1")
    return per.agg(F.count(F.lit(1)).alias("voted"), F.count_if(F.col("lo") == F.col("hi")).alias("identical")).select("voted", "identical", F.try_divide(F.col("identical").cast("double"), F.col("voted")).alias("identical_share"), ((F.col("voted") >= warn_at) & (F.col("voted") == F.col("identical"))).alias("warns"))


def confusion(pairs: DataFrame, judged: str = "judged", human: str = "human") -> DataFrame:
    """``judged, human, n``."""
    return pairs.groupBy(F.col(judged).alias("judged"), F.col(human).alias("human")).agg(F.count(F.lit(1)).alias("n"))


def kappa(pairs: DataFrame, judged: str = "judged", human: str = "human") -> DataFrame:
    """``n, agreed, kappa``: Cohen's kappa in integers, (agreed n - S) / (n n - S) with S the sum over labels of both marginals;
    null where both sides used one identical label only, or there is no pair. Null labels are labels that match no human label."""
    c = confusion(pairs, judged, human)
    rows = c.groupBy(F.col("judged").alias("label")).agg(F.sum("n").alias("a"))
    cols = c.groupBy(F.col("human").alias("label")).agg(F.sum("n").alias("b"))
    chance = rows.join(cols, "label").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("s"))
    seen = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("judged") == F.col("human"), F.col("n"))), F.lit(0)).alias("agreed"))
    n = F.col("n")
    return seen.crossJoin(F.broadcast(chance)).select("n", "agreed", F.try_divide((F.col("agreed") * n - F.col("s")).cast("double"), (n * n - F.col("s")).cast("double")).alias("kappa"))


def reliability_bins(judged: DataFrame, n_bins: int = 10, confidence: str = "confidence", correct: str = "correct") -> DataFrame:
    """``bin, n, confidence, accuracy``: equal-width bins of [0, 1], 1 in the last; empty bins stay, with null means. Rows
    without confidence or correctness (unparseable answers) are in no bin."""
    at = F.least(F.floor(F.col(confidence) * n_bins), F.lit(n_bins - 1)).cast("int")
    per = judged.filter(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return judged.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(per), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """``ece``: mean gap of accuracy and confidence weighted by bin; null where all bins are empty."""
    return bins.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n")).alias("ece"))


def calibration(judged: DataFrame, n_bins: int = 10, kappa_min: float = 0.7, ece_max: float = 0.1, min_gold: int = 30) -> DataFrame:
    """One row ``n, agreed, kappa, ece, accuracy, unparseable, trusted`` of ``judged`` (judged, human, confidence): unparseable
    answers (null) count as wrong in kappa and accuracy, and are in no bin."""
    correct = F.when(F.col("judged").isNotNull(), F.col("judged").eqNullSafe(F.col("human")))
    ece = expected_calibration_error(reliability_bins(judged.withColumn("correct", correct), n_bins))
    rate = judged.agg(F.avg(F.coalesce(correct, F.lit(False)).cast("double")).alias("accuracy"), F.count_if(F.col("judged").isNull()).alias("unparseable"))
    ok = F.coalesce((F.col("kappa") >= kappa_min) & (F.col("ece") <= ece_max) & (F.col("n") >= min_gold), F.lit(False))
    return kappa(judged).crossJoin(F.broadcast(ece)).crossJoin(F.broadcast(rate)).withColumn("trusted", ok)


def residual_by_label(c: DataFrame) -> DataFrame:
    """``judged, residual``: one minus the precision of each judged label of a confusion table."""
    return c.groupBy("judged").agg((1 - F.coalesce(F.sum(F.when(F.col("judged") == F.col("human"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("residual"))


def interleave(examples: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """The first ``n`` examples taken one of each label in turn, labels by first appearance.

    No more than ``n`` of a label can be among them, so each task hands on its first ``n`` of a label at most."""
    tops = examples.withColumn("_depth", F.row_number().over(Window.partitionBy(label).orderBy(order))).filter(F.col("_depth") <= n)
    first = Window.partitionBy(label)
    return tops.withColumn("_first", F.min(order).over(first)).orderBy("_depth", "_first").limit(n).drop("_depth", "_first")


def vote_agreement(ballots: DataFrame, labels: DataFrame, means: dict[str, str] | None = None, key: str = "record_id", vote: str = "vote") -> DataFrame:
    """``key, agree, cast_votes, agrees, code``: how many votes mean the label (labels: key, label), abstentions left out.

    ``means`` maps a verdict to the label it means, without it a verdict means itself. More than half of the votes cast must
    agree: else ``consistency_disagrees``, or ``consistency_no_votes`` where none was cast."""
    b = ballots.filter(F.col(vote).isNotNull())
    meaning = F.col(vote)
    if means is not None:
        meaning = F.try_element_at(F.create_map(*[F.lit(x) for kv in means.items() for x in kv]), F.col(vote))
    counted = ballots.select(key).distinct().join(b.select(key, meaning.alias("_m")), key, "left").join(labels, key, "left")
    # votes are counted by key; a missing vote has a null meaning and is told from an unknown verdict by the count of votes
    votes = b.groupBy(key).agg(F.count(F.lit(1)).alias("cast_votes"))
    agree = counted.groupBy(key).agg(F.count_if(F.col("_m") == F.col("label")).alias("agree"))
    out = agree.join(votes, key, "left").select(key, "agree", F.coalesce("cast_votes", F.lit(0)).alias("cast_votes"))
    agrees = F.col("agree") * 2 > F.col("cast_votes")
    return out.select("*", agrees.alias("agrees"), F.when(F.col("cast_votes") == 0, "consistency_no_votes").when(~agrees, "consistency_disagrees").alias("code"))


def judge_view(records: DataFrame, fields: list[str], hidden: tuple[str, ...] = ("label",)) -> DataFrame:
    """The columns a judge may see: ``fields`` that exist, without hidden and private ones."""
    return records.select(*[f for f in fields if f in records.columns and f not in hidden and not f.startswith("_")])


def judge_prompt(rubric: dict, view: Column) -> Column:
    """The prompt of a blind judge: the verdicts and criteria of a rubric, the shape of the reply, and the record's view (JSON)."""
    lines = ["You are given one record. Judge it only by the rubric below.", "", "Verdicts: " + ", ".join(rubric["verdict"]["values"])]
    for c in rubric["criteria"]:
        lines.append(f"- {c['name']}: " + (", ".join(map(str, c["values"])) if c.get("values") else f"an integer from {c['min']} to {c['max']}"))
    names = [c["name"] for c in rubric["criteria"]]
    lines += ["", "Reply with one JSON object with the keys verdict, scores (" + ", ".join(names) + ") and confidence (verdict, " + ", ".join(names) + "; numbers from 0 to 1)" + (", and reason." if rubric.get("reason_required") == "always" else "."), "", "Record:"]
    return F.concat(F.lit("\n".join(lines) + "\n"), view)


def judge_against_human(results: DataFrame, human: DataFrame, key: str = "item_id") -> DataFrame:
    """``judged, human, confidence`` pairs of gold items: every human label with the judge's result for the same item, null
    where the judge has none."""
    return human.join(results, key, "left").select("judged", "human", "confidence")


def decode(levels: Column) -> Column:
    """The level of highest probability of a map, ties to the level listed first."""
    best = F.array_max(F.map_values(levels))
    return F.element_at(F.filter(F.map_entries(levels), lambda e: e["value"] == best), 1)["key"]
