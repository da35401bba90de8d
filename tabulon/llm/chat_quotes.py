"""Chat formatting by quotation linking.

A message's lines are parsed for quote marks. What a message says itself, and each passage that it quotes at some
level, are normalised and hashed, as wholes, as paragraphs and as lines. Quoted hashes are joined with what messages say
themselves; the earlier message that most of a quotation's hashes lead to is its origin. Another conversation's
message is one only by passages of `LEAST` characters at least: `ok` and `thanks` say nothing of where they are from.
A conversation's messages are then ordered so that replies follow what they answer, without the quotations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import cut, distributed_rank, ship, tidy
from tabulon.llm.components import components

_MARKS = re.compile(r"(?:[ \t]*>)+")
_INTRO = re.compile(r"^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$", re.IGNORECASE)
_BLANKS = re.compile(r"\s+")

FREQUENT = 16  # messages that say a hash, from where it is joined by sets
LEAST = 24  # characters, once normalised, of what can be from another conversation
LONG = b"\x01"  # the first byte of their hashes

MESSAGES = "conv_id long, turn long, role string, content string, n_quotes int, said array<binary>, quoted array<struct<depth:int,passage:int,units:array<binary>>>"


def quote_levels(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) of each line; 0 is what the message says itself."""
    out = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        out.append((marks[0].count(">"), line[marks.end() :]) if marks else (0, line))
    return out


def normalised(text: str) -> str:
    return _BLANKS.sub(" ", text).strip().lower()


def units(lines: list[str]) -> list[bytes]:
    """Hashes of a passage as a whole, of its paragraphs and of its lines; the first byte tells which have `LEAST` characters."""
    whole = normalised("\n".join(lines))
    paragraphs = [normalised(p) for p in re.split(r"\n\s*\n", "\n".join(lines))]
    every = dict.fromkeys(x for x in [whole, *paragraphs, *map(normalised, lines)] if x)
    return [(LONG if len(x) >= LEAST else b"\x00") + hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=16).digest() for x in every]


def parse(text: str | None) -> tuple[str, list[bytes], list[tuple[int, int, list[bytes]]]]:
    """What a message says itself, its hashes, and (level, number, hashes) of each passage that it quotes.

    A passage is a run of lines of one level; the line that introduces a quotation goes with it.
    """
    levels = quote_levels(text or "")
    runs: list[tuple[int, list[str]]] = []
    for level, line in levels:
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(line)
    for (level, lines), (after, _) in zip(runs, runs[1:]):
        while after > level and lines and (not lines[-1].strip() or _INTRO.match(lines[-1])):
            if _INTRO.match(lines.pop()):
                break
    own = [lines for level, lines in runs if not level]
    said = list(dict.fromkeys(u for lines in own for u in units(lines)))
    quoted = [(level, lines) for level, lines in runs if level]
    content = "\n".join(x for lines in own for x in lines)
    return (content.strip() if quoted else content), said, [(level, k, u) for k, (level, lines) in enumerate(quoted) if (u := units(lines))]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quoted_kind = pa.list_(pa.struct([("depth", pa.int32()), ("passage", pa.int32()), ("units", pa.list_(pa.binary()))]))
    for batch in batches:
        found = [parse(t.as_py()) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), batch.column(2),
                pa.array([None if t.as_py() is None else c for t, (c, _, _) in zip(batch.column(3), found)], pa.string()), pa.array([len(q) for _, _, q in found], pa.int32()),
                pa.array([s for _, s, _ in found], pa.list_(pa.binary())),
                pa.array([[dict(zip(("depth", "passage", "units"), x)) for x in q] for _, _, q in found], quoted_kind),
            ],
            names=["conv_id", "turn", "role", "content", "n_quotes", "said", "quoted"],
        )


def messages(conversations: DataFrame) -> DataFrame:
    """The parsed messages: conv_id, turn, role, content, n_quotes, said, quoted; cut."""
    ship(conversations.sparkSession)
    return cut(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(_parsed, MESSAGES))


def _is_long(unit: str | Column) -> Column:
    return F.substring(unit, 1, 1) == F.lit(LONG)


def _two_firsts(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of each key the greatest row by `order` (which ends in -conv, -turn; named c and t), and the greatest of another conversation."""
    top = F.struct(*order)
    first = rows.groupBy(key).agg(F.max(top).alias("top"))
    other = rows.join(first.select(F.col(key).alias("_key"), F.col("top.c").alias("_c")), (F.col(key) == F.col("_key")) & (-F.col("of_conv_id") != F.col("_c")))
    return first.unionByName(other.groupBy(key).agg(F.max(top).alias("top"))).select(key, "top.*")


def quote_links(parsed: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """conv_id, turn, depth, passage, of_conv_id, of_turn, shared: the origin of each passage that a message quotes.

    The origin is an earlier message of the same conversation that shares most hashes, else the message of another
    conversation that shares most long ones (there is no time between conversations, so none is earlier); of equal
    ones the first. Hashes that at most `frequent` messages say are joined with
    all of these. The others of a message or passage are its common set: equal sets are joined once, and of a
    message set the first place in a conversation and the first two of all conversations stand for the rest, as
    no later place can be the origin. So counts are exact, and common phrases meet no more rows than there are
    different sets. `frequent` decides on the cost only.
    """
    quote, place = ["conv_id", "turn", "depth", "passage"], ["of_conv_id", "of_turn"]
    inline = parsed.filter("n_quotes > 0 and conv_id is not null").select("conv_id", "turn", F.inline("quoted"))
    quoted = inline.select(*quote, F.explode("units").alias("unit")).distinct()
    every = parsed.filter("conv_id is not null").select(F.col("conv_id").alias("of_conv_id"), F.col("turn").alias("of_turn"), F.explode("said").alias("u")).distinct()
    said = cut(every.join(quoted.select("unit").distinct(), F.col("u") == F.col("unit"), "left_semi"))
    common = cut(said.groupBy(F.col("u").alias("common")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > frequent).select("common"))
    marked_said = said.join(common, F.col("u") == F.col("common"), "left")
    marked_quoted = cut(quoted.join(common, F.col("unit") == F.col("common"), "left"))
    of_set = F.sort_array(F.collect_set("common"))
    # one row for a message or passage, with its common hashes
    said_sets = cut(marked_said.filter("common is not null").groupBy(*place).agg(of_set.alias("said_set")))
    quoted_sets = cut(marked_quoted.filter("common is not null").groupBy(*quote).agg(of_set.alias("quoted_set")))

    apart = F.col("conv_id") != F.col("of_conv_id")
    earlier = F.when(apart, _is_long("unit")).otherwise(F.col("of_turn") < F.col("turn"))
    rare = marked_quoted.filter("common is null").drop("common").join(marked_said.filter("common is null").drop("common"), (F.col("unit") == F.col("u")) & earlier)
    counted = rare.groupBy(*quote, *place).agg(F.count(F.lit(1)).alias("n"))
    same = lambda left, right, names: reduce(lambda x, y: x & y, [left[c].eqNullSafe(right[c]) for c in names])
    with_said = counted.join(said_sets, same(counted, said_sets, place), "left").select(*[counted[c] for c in counted.columns], "said_set")
    with_both = with_said.join(quoted_sets, same(with_said, quoted_sets, quote), "left").select(*[with_said[c] for c in with_said.columns], "quoted_set")
    met = F.array_intersect("said_set", "quoted_set")
    both = F.size(F.filter(met, lambda u: ~apart | _is_long(u)))
    by_rare = with_both.select(*quote, *place, (F.col("n") + F.when(F.col("said_set").isNull() | F.col("quoted_set").isNull(), 0).otherwise(both)).alias("shared"))

    inside = cut(said_sets.groupBy("of_conv_id", "said_set").agg(F.min("of_turn").alias("of_turn")))
    key = F.col("unit") == F.col("u")
    here = quoted_sets.select(*quote, F.explode("quoted_set").alias("unit")).join(inside.select(*place, "said_set", F.explode("said_set").alias("u")), key & (F.col("conv_id") == F.col("of_conv_id")) & (F.col("of_turn") < F.col("turn")))
    by_here = here.groupBy(*quote, *place, "said_set").agg(F.count(F.lit(1)).alias("shared")).drop("said_set")

    back = [(-F.col("of_conv_id")).alias("c"), (-F.col("of_turn")).alias("t")]
    places = _two_firsts(inside, "said_set", back).select("said_set", (-F.col("c")).alias("of_conv_id"), (-F.col("t")).alias("of_turn"))
    kinds = quoted_sets.select("quoted_set").distinct()
    met = kinds.select("quoted_set", F.explode(F.filter("quoted_set", _is_long)).alias("unit")).join(places.select(*place, "said_set", F.explode("said_set").alias("u")), key)
    sizes = met.groupBy("quoted_set", *place, "said_set").agg(F.count(F.lit(1)).alias("shared"))
    tops = _two_firsts(sizes, "quoted_set", [F.col("shared"), *back]).select(F.col("quoted_set").alias("kind"), "shared", (-F.col("c")).alias("of_conv_id"), (-F.col("t")).alias("of_turn"))
    by_there = quoted_sets.join(tops, (F.col("quoted_set") == F.col("kind")) & (F.col("conv_id") != F.col("of_conv_id"))).select(*quote, *place, "shared")

    votes = by_rare.unionByName(by_here).unionByName(by_there)
    best = F.max(F.struct(F.col("of_conv_id") == F.col("conv_id"), "shared", (-F.col("of_conv_id")).alias("c"), (-F.col("of_turn")).alias("t"))).alias("best")
    return votes.groupBy(*quote).agg(best).select(*quote, (-F.col("best.c")).alias("of_conv_id"), (-F.col("best.t")).alias("of_turn"), F.col("best.shared").alias("shared"))


def _round(state: DataFrame, forward: bool) -> DataFrame:
    """`state` (conv_id, turn, of_conv_id, of_turn, level, waits) after a round.

    forward: a waiting link before whose origin no message of the conversation has a waiting link gets its level,
    one more than the highest there. Else: a waiting link after whose message none starts waits no more.

    What a conversation's links tell is summed up before it meets them: the first or last turn that waits, and from which
    turn on each level is reached. So a conversation that is quoted by very many is no group of theirs.
    """
    if not forward:
        told = state.filter("waits").groupBy(F.col("of_conv_id").alias("c")).agg(F.max("of_turn").alias("last"))
        seen = state.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left")
        ready = F.col("waits") & (F.col("last").isNull() | (F.col("last") < F.col("turn")))
        return seen.select("conv_id", "turn", "of_conv_id", "of_turn", "level", (F.col("waits") & ~ready).alias("waits"))
    own = state.groupBy("conv_id", "level").agg(F.min(F.when(F.col("waits"), F.col("turn"))).alias("first"), F.min("turn").alias("from"))
    told = own.groupBy(F.col("conv_id").alias("c")).agg(F.min("first").alias("first"), F.collect_list(F.struct(F.coalesce("level", F.lit(0)).alias("level"), "from")).alias("steps"))
    seen = state.join(told, F.col("of_conv_id").eqNullSafe(F.col("c")), "left")
    ready = F.col("waits") & (F.col("first").isNull() | (F.col("first") > F.col("of_turn")))
    reached = F.array_max(F.transform(F.filter("steps", lambda x: x["from"] <= F.col("of_turn")), lambda x: x["level"]))
    level = F.when(ready, F.coalesce(reached, F.lit(0)) + 1).otherwise(F.col("level"))
    return seen.select("conv_id", "turn", "of_conv_id", "of_turn", level.alias("level"), (F.col("waits") & ~ready).alias("waits"))


def _waiting(state: DataFrame) -> int:
    return state.filter("waits").count()


def reply_levels(across: DataFrame) -> DataFrame:
    """conv_id, steps (array of turn and level): from a step's turn on, a conversation's messages have its level at least.

    `across` has links between conversations (conv_id, turn, of_conv_id, of_turn). A message's level is above that of
    what it or a message before it in its conversation quotes, so order by level keeps turns and puts replies
    after their origins. A round settles the links whose origins are settled; there are as many as the longest chain
    of links. Where links go round in a circle, those of its links that lead to a later conversation or turn are
    left out.
    """
    first = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))  # noqa: E731  (null turns come first)
    state = cut(across.select("conv_id", first("turn").alias("turn"), "of_conv_id", first("of_turn").alias("of_turn")).distinct().withColumns({"level": F.lit(None).cast("int"), "waits": F.lit(True)}))
    left = _waiting(state)
    while left:
        state = cut(_round(state, True))
        now = _waiting(state)
        if now == left:  # circles, and what comes after them: that is peeled off from its ends
            circle = cut(state.filter("waits"))
            n = now
            while True:
                circle = cut(_round(circle, False).filter("waits"))
                if (rest := circle.count()) == n:
                    break
                n = rest
            later = circle.filter(F.struct("of_conv_id", "of_turn") > F.struct("conv_id", "turn")).select("conv_id", "turn", "of_conv_id", "of_turn")
            state = cut(state.join(later, ["conv_id", "turn", "of_conv_id", "of_turn"], "left_anti"))
            now = _waiting(state)
        left = now
        tidy(state)
    steps = state.groupBy("conv_id", "level").agg(F.min("turn").alias("turn"))
    return steps.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "level")).alias("steps"))


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """A row for each message: conversation, position, conv_id, turn, role, content, n_quotes, reply_conv_id, reply_turn.

    content is the text without quotations (unchanged where there are none; null if the text is null). The reply
    columns name the message that the first quoted passage of the lowest level comes from, else the message before
    in the conversation, else null. Conversations that quote each other are one, named by their smallest conv_id;
    position counts its messages from 0, so that what is quoted comes before the reply and turns keep their order, else
    by conv_id and turn (`reply_levels`).
    Messages without conv_id are a conversation of their own, in order of turn, null first. Repeated messages each have a
    row. An empty table gives no rows. Other columns are not read.
    """
    parsed = messages(conversations)
    links = cut(quote_links(parsed))
    across = cut(links.filter(F.col("conv_id") != F.col("of_conv_id")))
    roots = components(across.select(F.col("conv_id").alias("a"), F.col("of_conv_id").alias("b")))
    levels = reply_levels(across).select(F.col("conv_id").alias("s_conv"), "steps")
    nearest = links.groupBy("conv_id", "turn").agg(F.min(F.struct("depth", "passage", "of_conv_id", "of_turn")).alias("o")).select(
        F.col("conv_id").alias("l_conv"), F.col("turn").alias("l_turn"), F.col("o.of_conv_id").alias("o_conv"), F.col("o.of_turn").alias("o_turn")
    )
    joined = parsed.join(roots, F.col("conv_id") == F.col("node"), "left").join(nearest, (F.col("conv_id") == F.col("l_conv")) & (F.col("turn") == F.col("l_turn")), "left")
    rows = joined.select(F.coalesce("root", "conv_id").alias("conversation"), "conv_id", "turn", "role", "content", "n_quotes", "o_conv", "o_turn", F.col("root").isNotNull().alias("merged"))
    # no task holds a conversation that has more messages than a range partition
    ranked = cut(distributed_rank(rows, [F.col("conv_id")], [F.col("turn"), F.xxhash64("role", "content")], "nth"))
    merged = ranked.filter("merged").join(levels, F.col("conv_id") == F.col("s_conv"), "left").drop("s_conv")
    passed = F.filter("steps", lambda s: s["turn"] <= F.coalesce(F.col("turn"), F.lit(-(1 << 63))))
    leveled = cut(merged.withColumn("level", F.coalesce(F.array_max(F.transform(passed, lambda s: s["level"])), F.lit(0))).drop("steps"))
    placed = distributed_rank(leveled, [F.col("conversation")], [F.col("level"), F.col("conv_id"), F.col("nth")], "position").drop("level")
    every = ranked.filter("not merged").withColumn("position", F.col("nth")).unionByName(placed)
    before = ranked.select((F.col("nth") + 1).alias("b_nth"), F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn"))
    found = every.join(before, (F.col("nth") == F.col("b_nth")) & F.col("conv_id").eqNullSafe(F.col("b_conv")), "left")
    quoted = F.col("o_conv").isNotNull()
    return found.select(
        "conversation", "position", "conv_id", "turn", "role", "content", "n_quotes",
        F.when(quoted, F.col("o_conv")).otherwise(F.col("b_conv")).alias("reply_conv_id"), F.when(quoted, F.col("o_turn")).otherwise(F.col("b_turn")).alias("reply_turn"),
    )


def threads(ordered: DataFrame, most: int = 1000) -> DataFrame:
    """conversation, part, messages (array of role and content, in order): rows of `most` messages at most, the parts from 0.

    A null content stays null. An empty table gives no rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("position", "role", "content")))
    parts = ordered.groupBy("conversation", F.expr(f"int(position div {most})").alias("part"))
    return parts.agg(F.transform(listed, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
