"""Multi-party dialogues rendered from each participant's point of view, with loss masks.

Everything is built-in functions on columns: turns are put in order as arrays and rendered by transforming them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SYSTEM_ROLES = ("system",)
UNNAMED = "unknown"

#: A conversation of more rows is sorted as a table and rendered in pieces of so many turns, which are then joined:
#: the plan differs, the result does not.
PIECE_TURNS = 512
#: Up to so many long conversations are broadcast to tell them apart; beyond, the join shuffles.
MAX_BROADCAST_ROWS = 100_000

SYSTEM, ASSISTANT, USER, END = "<|system|>\n", "<|assistant|>\n", "<|user|>\n", "<|end|>\n"


def turn_text(speaker: str, text: str, perspective: str, system_roles: tuple[str, ...] = SYSTEM_ROLES) -> tuple[str, int, int]:
    """A turn as ``perspective`` sees it, and the range of it that a loss covers (empty for others' turns): the rule in plain words."""
    if speaker in system_roles:
        return f"{SYSTEM}{text}{END}", 0, 0
    if speaker == perspective:
        return f"{ASSISTANT}{text}{END}", len(ASSISTANT), len(ASSISTANT) + len(text) + len(END)
    return f"{USER}{speaker}: {text}{END}", 0, 0


def render(turns: list[tuple[str, str]], perspective: str, system_roles: tuple[str, ...] = SYSTEM_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """(speaker, text) turns as one text, and the masked character ranges in it: the slow form, for tests."""
    parts, mask, at = [], [], 0
    for speaker, text in turns:
        piece, a, b = turn_text(speaker, text, perspective, system_roles)
        if b > a:
            mask.append((at + a, at + b))
        parts.append(piece)
        at += len(piece)
    return "".join(parts), mask


def _running(sizes: Column) -> Column:
    """0 and the running sums of an array of lengths, as longs."""
    return F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _rendered(grouped: DataFrame, keys: list[str], system_roles: tuple[str, ...]) -> DataFrame:
    """``grouped(<keys>, turns, who)`` with the text, length and mask of its turns as ``who`` sees them."""
    system = lambda t: t["role"].isin(*system_roles) if system_roles else F.lit(False)
    own = lambda t: (t["role"] == F.col("who")) & ~system(t)
    head = lambda t: F.when(system(t), SYSTEM).when(own(t), ASSISTANT).otherwise(F.concat(F.lit(USER), t["role"], F.lit(": ")))
    seen = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), own(t).alias("own")))
    placed = grouped.select(*keys, "who", F.size("turns").cast("long").alias("n_turns"), seen.alias("seen"))
    ends = _running(F.transform("seen", lambda p: F.length(p["head"]) + F.length(p["body"])))
    spread = placed.withColumn("ends", ends)
    ranges = F.transform("seen", lambda p, i: F.struct((F.col("ends")[i] + F.length(p["head"])).alias("start"), F.col("ends")[i + 1].alias("end"), p["own"].alias("own")))
    mask = F.transform(F.filter(ranges, lambda m: m["own"]), lambda m: F.struct(m["start"], m["end"]))
    text = F.array_join(F.transform("seen", lambda p: F.concat(p["head"], p["body"])), "")
    return spread.select(*keys, "who", "n_turns", F.element_at("ends", -1).alias("n_chars"), text.alias("text"), mask.alias("mask"))


def _speakers(grouped: DataFrame, roles: Column, system_roles: tuple[str, ...]) -> DataFrame:
    shown = F.filter(F.array_distinct(roles), lambda r: ~r.isin(*system_roles)) if system_roles else F.array_distinct(roles)
    return grouped.withColumn("who", F.explode(shown))


def _whole(turns: DataFrame, system_roles: tuple[str, ...]) -> DataFrame:
    """Conversations that fit one array each. A set, so that repeats are dropped before and while turns are gathered."""
    grouped = turns.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    return _rendered(_speakers(grouped, F.transform("turns", lambda t: t["role"]), system_roles), ["id"], system_roles)


def _in_pieces(turns: DataFrame, piece_turns: int, system_roles: tuple[str, ...]) -> DataFrame:
    """Long conversations: their turns are sorted over all tasks by range, also those of one conversation or one turn
    number, rendered piece by piece, and the pieces of a participant joined in order."""
    order = ["id", "turn", "role", "text"]
    # The place of a row is fixed by writing it down: partitions are ranges of the order, in order.
    placed = checkpointed(turns.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    pieces = placed.groupBy("id", F.floor(F.col("at") / piece_turns).alias("piece")).agg(F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    people = placed.select("id", F.col("role").alias("who")).distinct()
    people = people.filter(~F.col("who").isin(*system_roles)) if system_roles else people
    made = _rendered(pieces.join(people, "id"), ["id", "piece"], system_roles)
    joined = made.groupBy("id", "who").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("piece", "n_chars", "text", "mask"))).alias("pieces"))
    joined = joined.withColumn("ends", _running(F.transform("pieces", lambda p: p["n_chars"])))
    moved = F.transform("pieces", lambda p, i: F.transform(p["mask"], lambda m: F.struct((m["start"] + F.col("ends")[i]).alias("start"), (m["end"] + F.col("ends")[i]).alias("end"))))
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return joined.select("id", "who", "n_turns", F.element_at("ends", -1).alias("n_chars"), text.alias("text"), F.flatten(moved).alias("mask"))


def rotate_perspectives(
    conversations: DataFrame,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    system_roles: tuple[str, ...] = SYSTEM_ROLES,
    piece_turns: int = PIECE_TURNS,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """One row for each conversation and participant: ``<id_col>``, ``perspective``, ``n_turns``, ``n_chars``, ``text``
    and ``mask`` (array of struct<start, end>: character ranges of the participant's own turns).

    A participant is any speaker of the conversation but the system roles; its turns become the assistant's,
    everyone else's a named user's, system turns stay. Turns are ordered by number, then role and text. A row holds
    the whole dialogue, so it is bounded by what a string can hold (2 GB); nothing is cut.

    Defined cases: exact repeats of a turn count once; other rows with the same number all stay; a null number
    comes first; a null role is the speaker "unknown"; a null text is empty; rows without a conversation id belong
    to no dialogue and are left out; a conversation of system turns alone has no row; an empty table gives no rows.
    Other columns are not read, whatever their names. Conversations of more than ``piece_turns`` rows are sorted as
    a table and put together from pieces, with the same result.
    """
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(UNNAMED)).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    long = checkpointed(turns.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > piece_turns).select(F.col("id").alias("long_id")))
    many = long.count()
    if many:
        those = F.broadcast(long) if many <= max_broadcast_rows else long
        here = F.col("id") == F.col("long_id")
        made = _whole(turns.join(those, here, "left_anti"), system_roles).union(_in_pieces(turns.join(those, here, "left_semi"), piece_turns, system_roles))
    else:
        made = _whole(turns, system_roles)
    return made.select(F.col("id").alias(id_col), F.col("who").alias("perspective"), "n_turns", "n_chars", "text", "mask")


#: DuckDB SQL for the rows of the query op4.
ORACLE_SQL = f"""
WITH turns AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '{UNNAMED}') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), seen AS (
    SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'
), pieces AS (
    SELECT conv_id, perspective, turn, role, t.text AS said,
        CASE WHEN role = 'system' THEN '<|system|>' || chr(10)
             WHEN role = perspective THEN '<|assistant|>' || chr(10)
             ELSE '<|user|>' || chr(10) || role || ': ' END AS head,
        t.text || '<|end|>' || chr(10) AS body
    FROM turns t JOIN seen USING (conv_id)
), placed AS (
    SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, said ROWS UNBOUNDED PRECEDING) AS upto
    FROM pieces
)
SELECT conv_id, perspective, count(*) AS n_turns, CAST(max(upto) AS BIGINT) AS n_chars,
    string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, said) AS text,
    coalesce(string_agg(CAST(upto - length(body) AS BIGINT) || '-' || CAST(upto AS BIGINT), ',' ORDER BY upto) FILTER (WHERE role = perspective), '') AS mask
FROM placed GROUP BY conv_id, perspective
"""
