"""Multi-party perspective rotation of dialogues, of DataFrame functions alone.

For every participant of a conversation the whole dialogue is rendered with that participant's
turns as the assistant's (trained on, mask 1) and all others' as users with their names (mask 0).
Turns of NO_SPEAKER roles are context in every rendering and never a perspective.

Nothing that was said can pass for a mark: in texts `<|` becomes `<||`, so only marks have a letter
after it, and in names `%`, `|`, `<`, `>` and line ends are written as %XX. Both can be undone.

`rotate` has a row for each perspective and turn with the turn's place in the rendering, so a
conversation of any length stays spread over tasks: offsets are sums within blocks of BLOCK turn
numbers plus sums over blocks, and a conversation with very many turns is joined to its
participants in several tasks. `render` joins turns to the rendered text, in parts that begin at
turns: a part holds the turns that begin in one stretch of PART characters, so parts are bounded and
in order they are the whole dialogue.

Defined cases: a null text renders as empty; a null speaker is the participant UNKNOWN; a null turn
comes first; turns that share a number are ordered by speaker and text, and equal rows follow each
other; a null conversation is a conversation of its own; one without participants gives no rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join

NO_SPEAKER, UNKNOWN, BLOCK, PART = ("system",), "unknown", 256, 1 << 16
END = "<|end|>\n"


def quoted(text: Column) -> Column:
    """A text that holds no marks."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def quoted_name(name: Column) -> Column:
    """A name that cannot end its mark."""
    for c in "%|<>\r\n":
        name = F.replace(name, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return name


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, role, name, content, mask, start, end of every rendered turn.

    `learned` is where in content the part begins that is trained on if mask is 1: its text and end.
    """
    said = turns.select(
        F.col(f"`{conversation}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{speaker}`").cast("string"), F.lit(UNKNOWN)).alias("name"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("conv", F.struct("conv_id"))  # a key that isn't null
    participants = said.filter(~F.col("name").isin(*NO_SPEAKER)).select("conv", F.col("name").alias("perspective")).distinct()
    role = F.when(F.col("name").isin(*NO_SPEAKER), F.col("name")).when(F.col("name") == F.col("perspective"), "assistant").otherwise("user")
    head = F.when(F.col("role") == "user", F.concat(F.lit("<|user name="), quoted_name(F.col("name")), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n")))
    rendered = (
        spread_join(said, participants, ["conv"])
        .withColumn("role", role)
        .withColumn("head", head)
        .withColumn("content", F.concat("head", quoted(F.col("text")), F.lit(END)))
        .withColumn("block", F.floor(F.col("turn") / BLOCK))
        .withColumn("size", F.length("content").cast("long"))
    )
    keys = ["conv_id", "perspective", "block"]
    order = ["turn", "name", "text"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rendered.groupBy(*keys).agg(F.sum("size").alias("size")).select(*(F.col(k).alias(f"b_{k}") for k in keys), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ahead"))
    placed = rendered.withColumn("upto", F.sum("size").over(inside))
    matched = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    end = F.col("ahead") + F.col("upto")
    return placed.join(blocks, matched[0] & matched[1] & matched[2]).select(
        "conv_id", "perspective", "turn", "role", "name", "content", F.length("head").cast("long").alias("learned"), (F.col("role") == "assistant").cast("int").alias("mask"), (end - F.col("size")).alias("start"), end.alias("end")
    )


def render(turns: DataFrame, part: int = PART, **columns: str) -> DataFrame:
    """conv_id, perspective, part, start (in the whole dialogue), rendered, n_turns and masks of every part.

    `masks` are the spans of `rendered` that are trained on: what the perspective says, with its end mark.
    """
    said = F.struct("start", "end", "content", "learned", "mask")
    parts = rotate(turns, **columns).groupBy("conv_id", "perspective", F.floor(F.col("start") / part).alias("part")).agg(F.array_sort(F.collect_list(said)).alias("said"), F.min("start").alias("start"))
    masks = F.transform(F.filter("said", lambda x: x["mask"] == 1), lambda x: F.struct((x["start"] + x["learned"] - F.col("start")).alias("start"), (x["end"] - F.col("start")).alias("end")))
    return parts.select("conv_id", "perspective", "part", "start", F.array_join(F.transform("said", lambda x: x["content"]), "").alias("rendered"), F.size("said").alias("n_turns"), masks.alias("masks"))
