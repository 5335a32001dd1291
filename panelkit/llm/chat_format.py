"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt; what follows
on either side is its completion, in which only assistant turns are trained on.
Output is one row per rendered turn, so that a conversation of any length is
never gathered in one task; ``assembled`` joins the rows of ordinary ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.prefix import row_numbers

from ._common import materialise

# The chat template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _turns(df: DataFrame) -> DataFrame:
    """(pair_id, turn, place, role, text) with repeated rows once. Turns that
    share a number stand in order of role and text, at places 0, 1, ..."""
    clean = df.where("pair_id IS NOT NULL").select(
        "pair_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).distinct()
    tied = Window.partitionBy("pair_id", "turn").orderBy("role", "text")
    return clean.withColumn("place", F.row_number().over(tied) - 1).where("turn IS NOT NULL")


def rendered(role: Column, text: Column) -> Column:
    """One turn by the template. ``<|`` inside a text is broken up, so that no
    text can write a marker."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), safe(role), F.lit("\n"), safe(text), F.lit(CLOSE))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per rendered turn of each pair: ``pair_id``, ``part`` (prompt,
    chosen or rejected), ``turn``, ``place``, ``role``, ``text``, ``n_chars``,
    ``train_from`` and ``train_to`` (the characters of this text that are
    trained on: an assistant's words and end marker in a completion, else null).

    Both tables have pair_id, turn, role, text; more columns are ignored. Null
    text is empty, a null role is ``unknown``, rows with a null pair or turn go,
    rows that repeat count once, and turns that share a number are ordered by
    role and text. Where one side is missing, the other is all completion; equal
    sides are all prompt. Empty tables give an empty result."""
    a, b = _turns(chosen), _turns(rejected)
    at = ["pair_id", "turn", "place"]
    both = (a.select(*at, F.col("role").alias("role_a"), F.col("text").alias("text_a"), F.lit(True).alias("in_a"))
            .join(b.select(*at, F.col("role").alias("role_b"), F.col("text").alias("text_b"), F.lit(True).alias("in_b")), at, "full"))
    same = F.coalesce(F.col("in_a") & F.col("in_b") & (F.col("role_a") == F.col("role_b")) & (F.col("text_a") == F.col("text_b")), F.lit(False))
    both = both.withColumn("same", same)
    fork = both.where("NOT same").groupBy("pair_id").agg(F.min(F.struct("turn", "place")).alias("fork"))
    split = both.join(fork, "pair_id", "left")
    before = F.col("fork").isNull() | (F.struct("turn", "place") < F.col("fork"))
    side = lambda s: F.when(F.col(f"in_{s}") & ~before, F.struct(
        F.lit({"a": "chosen", "b": "rejected"}[s]).alias("part"), F.col(f"role_{s}").alias("role"), F.col(f"text_{s}").alias("text")))
    prompt = F.when(before, F.struct(F.lit("prompt").alias("part"), F.col("role_a").alias("role"), F.col("text_a").alias("text")))
    rows = split.select(*at, F.explode(F.filter(F.array(prompt, side("a"), side("b")), lambda x: x.isNotNull())).alias("x"))
    out = rows.select(*at, "x.part", "x.role", rendered(F.col("x.role"), F.col("x.text")).alias("text"))
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    return out.select("pair_id", "part", "turn", "place", "role", "text", F.length("text").cast("long").alias("n_chars"),
                      F.when(trained, F.lit(len(OPEN) + len("assistant\n")).cast("long")).alias("train_from"),
                      F.when(trained, (F.length("text") - 1).cast("long")).alias("train_to"))


def assembled(segments: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_spans, rejected_spans): whole
    strings, and the trained spans of the completions. For conversations that
    fit in memory each."""
    part = lambda p: F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct(
        "turn", "place", "text", "train_from", "train_to"))))
    whole = segments.groupBy("pair_id").agg(*[part(p).alias(p) for p in ("prompt", "chosen", "rejected")])
    text = lambda p: F.array_join(F.transform(p, lambda x: x["text"]), "")

    def spans(p: str) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
        step = lambda acc, x: F.struct(
            (acc["at"] + F.length(x["text"])).alias("at"),
            F.when(x["train_from"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["train_from"]).alias("start"), (acc["at"] + x["train_to"]).alias("end"))))).alias("spans"))
        return F.aggregate(p, start, step)["spans"]

    return whole.select("pair_id", *[text(p).alias(p) for p in ("prompt", "chosen", "rejected")],
                        spans("chosen").alias("chosen_spans"), spans("rejected").alias("rejected_spans"))


def swapped_responses(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from a table of conversations without preferences: chosen is each
    conversation that has an assistant turn, rejected the same with the text of
    its last assistant turn replaced by that of the next such conversation in
    order of ids (after the last id comes the first). Whatever follows that turn
    stays on both sides. Conversations without an assistant turn have nothing to
    prefer and give no pair; a single one is its own partner, so that both sides
    are equal. Of assistant turns that share the last number, the greatest text
    is the last."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    last = (turns.where("role = 'assistant'").groupBy("conv_id")
            .agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last")))
    numbered = materialise(row_numbers(last, ["conv_id"], "n"))
    count = F.broadcast(numbered.agg(F.count("*").alias("of")))  # one row
    before = numbered.crossJoin(count).select((F.col("n") % F.col("of") + 1).alias("n"), "conv_id", F.col("last.turn").alias("end"), F.col("last.text").alias("own"))
    ends = before.join(numbered.select("n", F.col("last.text").alias("swap")), "n").drop("n")
    whole = turns.join(ends, "conv_id").select(
        F.col("conv_id").alias("pair_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
        F.expr("turn = end AND coalesce(role, '') = 'assistant' AND coalesce(text, '') = own").alias("final"), "swap")
    chosen = whole.select("pair_id", "turn", "role", "text")
    rejected = whole.select("pair_id", "turn", "role", F.when(F.col("final"), F.col("swap")).otherwise(F.col("text")).alias("text"))
    return chosen, rejected


CONVERSATIONS_SQL = """
    WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    final AS (SELECT conv_id, turn, text FROM turns WHERE role = 'assistant'
              QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) = 1),
    pairs AS (SELECT conv_id, turn AS last, text AS own, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS swap FROM final),
    chosen AS (SELECT conv_id, turn, role, text,
                      row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) - 1 AS place
               FROM turns JOIN pairs USING (conv_id)),
    swapped AS (SELECT DISTINCT conv_id, turn, role,
                       CASE WHEN turn = last AND role = 'assistant' AND text = own THEN swap ELSE text END AS text
                FROM turns JOIN pairs USING (conv_id)),
    rejected AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) - 1 AS place FROM swapped),
    fork AS (SELECT conv_id, min(turn * 1000000 + place) AS forked
             FROM chosen c FULL JOIN rejected r USING (conv_id, turn, place)
             WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY conv_id),
    parts AS (SELECT conv_id, CASE WHEN forked IS NULL OR turn * 1000000 + place < forked THEN 'prompt' ELSE 'chosen' END AS part, turn, place, role, text
              FROM chosen LEFT JOIN fork USING (conv_id)
              UNION ALL
              SELECT conv_id, 'rejected', turn, place, role, text FROM rejected JOIN fork USING (conv_id) WHERE turn * 1000000 + place >= forked),
    lines AS (SELECT *, '<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS line FROM parts)
    SELECT conv_id AS pair_id, part, turn, place, role, line AS text, length(line) AS n_chars,
           CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 22 END AS train_from,
           CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(line) - 1 END AS train_to
    FROM lines"""
