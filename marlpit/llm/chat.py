"""Chat formatting: a hidden Markov model recovers the roles of transcript lines, then turns are rendered in one form.

States are (role, first line of a turn or later line). What is seen of a line is its speaker marker ("User:", "### Assistant", "A>" ...) and
features of its text. Start, transition and emission counts come from labelled turns over all rows. The most likely path is Viterbi's; a
conversation of any length is cut into chunks of CHUNK_LINES lines: each chunk is reduced to the best score from each state before it to each state
at its end (a 6 x 6 table), FAN tables at a time are put together to tables of longer stretches, the best states are chosen from the
longest stretch down, and every chunk is decoded between the two states found. The path is one that Viterbi may give on the whole, while no task
gathers more than a chunk's lines or FAN tables.

A conversation comes back in parts of one chunk each, in order; put together with line ends they are its canonical form, and only the last part ends in <|end|>.

Defined results: null and empty turns are one empty line; unknown or null roles count as user; null turns count as turn 0; equal (conversation, turn) rows follow
each other in order of role and text; null conversation ids form one conversation; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlpit.functions.lineage import range_parts
from marlpit.llm.common import map_arrow, materialize

ROLES = ("system", "user", "assistant")
#: Words that mark a speaker, fixed values by role.
SPEAKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "client", "question", "q", "you", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "answer", "a", "gpt"),
}
ROLE_OF = {word: role for role, words in SPEAKERS.items() for word in words}
MARKER = re.compile(r"^\s*(?:\[[\d:. -]+\]\s*)?(?:[#>*<|\[( ]{0,6})([A-Za-z]{1,12}|(?:Speaker|Person) \w{1,3})(?:[\])>|*]{1,3}:?|:)\s*", re.IGNORECASE)
#: Kinds of markers: none, an unknown speaker, or a role's.
MARKERS = ("none", "unknown", *ROLES)
STATES = 2 * len(ROLES)
CHUNK_LINES, FAN = 256, 256
#: Ways in which raw transcripts write a turn's speaker; the last gives nothing away.
STYLES = (("System: ", "User: ", "Assistant: "), ("### System: ", "### Human: ", "### AI: "), ("[system] ", "[customer] ", "[agent] "), ("system> ", "q> ", "a> "), ("", "", ""))


def split_marker(line: str) -> tuple[int, str]:
    """(kind of marker, line without it)."""
    m = MARKER.match(line)
    if not m:
        return 0, line
    role = ROLE_OF.get(m[1].lower())
    if role:
        return 2 + ROLES.index(role), line[m.end() :]
    return (1, line[m.end() :]) if m[1].lower().startswith(("speaker ", "person ")) else (0, line)


def line_symbol(line: str) -> int:
    """What the model sees of a line, as one number: marker, length class, question or not, blank or not."""
    kind, rest = split_marker(line)
    length = min(3, len(rest.split()) // 12)
    return ((kind * 4 + length) * 2 + rest.rstrip().endswith("?")) * 2 + (not rest.strip())


SYMBOLS = len(MARKERS) * 4 * 2 * 2


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with defined values for nulls."""
    role = F.lower(F.trim("role"))
    return conversations.select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.when(role.isin(*ROLES), role).otherwise("user").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )


def raw_turns(turns: DataFrame, seed: int = 5) -> DataFrame:
    """Labelled turns with the text as a raw transcript has it. A conversation has one style of markers; one turn in five has none and one in ten an unknown speaker's."""
    style = F.pmod(F.xxhash64(F.lit(seed), "conv_id"), F.lit(len(STYLES))).cast("int")
    at = F.pmod(F.xxhash64(F.lit(seed + 1), "conv_id", "turn"), F.lit(10))
    by_role = F.array(*[F.array(*[F.lit(s) for s in forms]) for forms in STYLES])
    number = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    known = F.get(F.get(by_role, style), number)
    marker = F.when(at < 2, F.lit("")).when(at == 2, F.concat(F.lit("Speaker "), (number + 1).cast("string"), F.lit(": "))).otherwise(known)
    return turns.withColumn("text", F.concat(marker, "text"))


def numbered_lines(turns: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """conv_id, n (number of the line in its conversation), chunk, lead, role, i (number of the line in its turn), line, of turns (conv_id, turn, role, text).

    Turns are counted in range partitions, and what a conversation has in earlier ones is added, so a long conversation is not gathered. The last line
    of a chunk is also the lead of the next one."""
    keys = ["conv_id", "turn", "role", "text"]
    ranged = range_parts(turns.select(*keys), [F.col(c) for c in keys], "part").withColumn("lines", F.split("text", "\n", -1))
    sizes = ranged.groupBy("conv_id", "part").agg(F.sum(F.size("lines")).alias("size"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.sum("size").over(earlier).alias("_shift")).filter("_shift > 0")
    own = Window.partitionBy("part", "conv_id").orderBy("turn", "role", "text")
    placed = ranged.withColumn("_end", F.sum(F.size("lines")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    # only the first conversation of a partition has begun in an earlier one, so there are no more rows of shift than partitions
    placed = placed.join(F.broadcast(shift), (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    begin = F.col("_end") - F.size("lines") + F.coalesce("_shift", F.lit(0))
    lines = placed.select("conv_id", begin.alias("begin"), "role", F.posexplode("lines").alias("i", "line")).withColumn("n", F.col("begin") + F.col("i")).drop("begin")
    chunk = F.floor(F.col("n") / chunk_lines)
    places = F.when(F.col("n") % chunk_lines == chunk_lines - 1, F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("lead")), F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("lead"))))
    places = F.coalesce(places, F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("lead"))))
    return lines.withColumn("place", F.explode(places)).select("conv_id", "n", "place.chunk", "place.lead", "role", "i", "line")


def chunked(lines: DataFrame) -> DataFrame:
    """conv_id, chunk, lines: a chunk's lines in order (n, lead, role, i, line), its lead first. A lead without a chunk is left out."""
    found = lines.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("n", "lead", "role", "i", "line"))).alias("lines"), F.every(F.col("lead")).alias("only_lead"))
    return found.filter("NOT only_lead").drop("only_lead")


def fit_hmm(lines: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, transition, emission) log probabilities from labelled, numbered lines. Counts are summed by Spark over all rows; what reaches the driver
    is one number for each pair of states or state and symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[int, int, int], int] = {}
            for lines in batch.column(0).to_pylist():
                before = -1
                for x in lines:
                    state = 2 * ROLES.index(x["role"]) + (x["i"] > 0)
                    if not x["lead"]:
                        for key in ((0, before, state), (1, state, line_symbol(x["line"]))):
                            counts[key] = counts.get(key, 0) + 1
                    before = state
            rows = [(*k, n) for k, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["kind", "a", "b", "n"])

    found = map_arrow(chunked(lines).select("lines"), run, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    start, move, show = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1), np.full((STATES, SYMBOLS), 0.05)
    for kind, a, b, n in found:
        if kind == 1:
            show[a, b] += n
        elif a < 0:
            start[b] += n
        else:
            move[a, b] += n
    for r in range(len(ROLES)):  # a later line follows a line of its own role
        start[2 * r + 1] = 1e-9
        for s in range(STATES):
            if s // 2 != r:
                move[s, 2 * r + 1] = 1e-9
    return tuple(np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, move, show))


def step_tables(symbols: np.ndarray, move: np.ndarray, show: np.ndarray) -> np.ndarray:
    """Best score from each state before a run of lines to each state at its end."""
    best = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    for s in symbols:
        best = (best[:, :, None] + move[None]).max(axis=1) + show[:, s]
    return best


def viterbi(symbols: np.ndarray, first: np.ndarray, move: np.ndarray, show: np.ndarray, last: int | None) -> list[int]:
    """The best path; first: log score of each state of the first line before it is seen; last: the state of the last line, if it is given."""
    score, back = first + show[:, symbols[0]], []
    for s in symbols[1:]:
        ways = score[:, None] + move
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + show[:, s]
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def table_of(x: list[float]) -> np.ndarray:
    return np.array(x).reshape(STATES, STATES)


def then(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The table of two stretches, one after the other."""
    return (one[:, :, None] + two[None]).max(axis=1)


def joined_tables(tables: DataFrame) -> DataFrame:
    """conv_id, k, best of stretches of FAN neighbours of tables (conv_id, k, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [reduce(then, [table_of(x["best"]) for x in members]).ravel().tolist() for members in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(best, pa.list_(pa.float64()))], ["conv_id", "k", "best"])

    return map_arrow(gathered(tables).select("conv_id", "k", "members"), run, "conv_id long, k long, best array<double>")


def gathered(tables: DataFrame) -> DataFrame:
    return tables.groupBy("conv_id", F.floor(F.col("k") / FAN).alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "best"))).alias("members"))


def same_conversation(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def chosen_states(tables: DataFrame, above: DataFrame | None) -> DataFrame:
    """conv_id, k, entry, exit, last: the states before and at the end of each stretch of tables on the best path; above: the same of the stretches of FAN of them, or None where there is one for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for conv, members, entry, end, last in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                score, back = table_of(members[0]["best"])[max(entry, 0)], []  # nothing stands before the first stretch: its rows are equal
                for x in members[1:]:
                    ways = score[:, None] + table_of(x["best"])
                    back.append(ways.argmax(axis=0))
                    score = ways.max(axis=0)
                path = [int(score.argmax()) if end < 0 else end]
                for b in reversed(back):
                    path.append(int(b[path[-1]]))
                path.reverse()
                rows += [(conv, x["k"], path[i - 1] if i else entry, path[i], last and i == len(members) - 1) for i, x in enumerate(members)]
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["conv_id", "k", "entry", "exit", "last"])

    groups = gathered(tables)
    if above is None:
        known = groups.select("conv_id", "k", "members", F.lit(-1).cast("long").alias("entry"), F.lit(-1).cast("long").alias("exit"), F.lit(True).alias("last"))
    else:
        above = above.select(F.col("conv_id").alias("_conv"), F.col("k").alias("_k"), "entry", "exit", "last")
        known = groups.join(above, same_conversation("conv_id", "_conv") & (F.col("k") == F.col("_k"))).select("conv_id", "k", "members", "entry", "exit", "last")
    return map_arrow(known, run, "conv_id long, k long, entry long, exit long, last boolean")


def parse_transcripts(lines: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """conv_id, chunk, last, lines, states: the lines of each chunk of numbered lines (roles are not read), the state of each, and whether the chunk is the last of its conversation."""
    shared = lines.sparkSession.sparkContext.broadcast(model)
    own = F.filter("lines", lambda x: ~x["lead"]).alias("lines")
    groups = materialize(chunked(lines).select("conv_id", "chunk", own), "chunks")

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, show = shared.value
        for batch in batches:
            best = []
            for chunk, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                symbols = np.array([line_symbol(x["line"]) for x in rows])
                if chunk:
                    best.append(step_tables(symbols, move, show).ravel().tolist())
                    continue
                score = start + show[:, symbols[0]]
                for s in symbols[1:]:
                    score = (score[:, None] + move).max(axis=0) + show[:, s]
                best.append(np.tile(score, STATES).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(best, pa.list_(pa.float64()))], ["conv_id", "k", "best"])

    levels = [materialize(map_arrow(groups, begun, "conv_id long, k long, best array<double>"), "tables")]
    longest = levels[0].agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    while longest >= FAN:
        longest //= FAN
        levels.append(materialize(joined_tables(levels[-1]), "tables"))
    bounds = None
    for tables in reversed(levels):
        bounds = chosen_states(tables, bounds)
    bounds = bounds.select(F.col("conv_id").alias("_conv"), F.col("k").alias("_chunk"), "entry", "exit", "last")
    joined = groups.join(bounds, same_conversation("conv_id", "_conv") & (F.col("chunk") == F.col("_chunk"))).select("conv_id", "chunk", "last", "lines", "entry", "exit")
    schema = joined.select("conv_id", "chunk", "last", "lines", F.array(F.lit(0)).alias("states")).schema

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, show = shared.value
        for batch in batches:
            out = []
            for rows, entry, end in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
                symbols = np.array([line_symbol(x["line"]) for x in rows])
                out.append(viterbi(symbols, start if entry < 0 else move[entry], move, show, end))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.int32()))], ["conv_id", "chunk", "last", "lines", "states"])

    return map_arrow(joined, decode, schema)


def canonical_turns(parsed: DataFrame) -> DataFrame:
    """conv_id, chunk, last, n_turns, roles, rendered: the turns that begin in a chunk, as "<|role|>" lines followed by their text, markers taken off. A chunk that begins within a turn
    goes on with its text; the last chunk of a conversation ends in <|end|>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_turns, roles, rendered = [], [], []
            for last, rows, states in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                own, out = [], []
                for x, s in zip(rows, states, strict=True):
                    if s % 2 == 0:
                        own.append(ROLES[s // 2])
                        out.append(f"<|{ROLES[s // 2]}|>")
                    out.append(split_marker(x["line"])[1] if s % 2 == 0 else x["line"])
                n_turns.append(len(own))
                roles.append(own)
                rendered.append("\n".join(out + ["<|end|>"] if last else out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_turns, pa.int64()), pa.array(roles, pa.list_(pa.string())), pa.array(rendered, pa.string())], ["conv_id", "chunk", "last", "n_turns", "roles", "rendered"])

    return map_arrow(parsed, run, "conv_id long, chunk long, last boolean, n_turns long, roles array<string>, rendered string")
