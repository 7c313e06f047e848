"""Chat formatting: a hidden Markov model recovers who speaks, before turns are rendered in one form.

A line's observation is its speaker marker, if it has one that is known (``User:``, ``### Assistant``, or
a given role), and features of the line: length, question mark, list or code, several paragraphs. States
are the roles. Viterbi finds the likeliest roles of a conversation.

Transition and feature probabilities are counted from all lines with a marker, by Spark; a marker is
believed but for one in a million.

Long conversations: lines are sorted by ranges, numbered within their conversations and gathered in blocks
of ``BLOCK`` lines, whatever their positions are; a conversation may fill many ranges. A block is summed up by the best
score from each role before it to each role at its end, a matrix; the matrices of ``BLOCK`` blocks make
that of a larger block, and so on until a conversation has one. The best ends are then handed down again
and each block decoded between them. No task holds more than a block, however long a conversation is, and
the result is that of Viterbi over the whole. Only codes of lines are gathered, never texts.

Edge cases: lines are ordered by their position, ties by a hash of role and text. Equal lines at one
position are decoded once and get the same role. Null ids form one conversation, null positions come first.
Null texts are empty lines. Unknown markers count as none. Without any marker in the table the chances
are even and roles start with a user and alternate. An empty table gives an empty table; other columns
pass through, and a column named like a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from billweave.llm.common import aside, named, stored

ROLES = ("system", "user", "assistant")
#: Names of speakers and their role.
SPEAKERS = {
    "system": "system",
    "instruction": "system",
    "user": "user",
    "human": "user",
    "customer": "user",
    "question": "user",
    "q": "user",
    "assistant": "assistant",
    "ai": "assistant",
    "bot": "assistant",
    "model": "assistant",
    "answer": "assistant",
    "a": "assistant",
}
MARKER = r"^\s*(?:[#>*\[(]+\s*)?(" + "|".join(SPEAKERS) + r")(?:[*\])]+)?\s*(?:[:>]|[*]+:?|\n)(?:[*]+)?[ \t]*"
BLOCK = 256
DOUBT = 1e-6
#: Values of each feature of a line.
FEATURES = {"length": 6, "question": 2, "items": 2, "paragraphs": 3, "first": 2}
NEW = ["speaker", "starts_turn", "is_first", "is_last"]
NONE = len(ROLES)
START = len(ROLES)

_MATRIX = "array<double>"


def marker_of(role: Column, text: Column) -> Column:
    """The number of the role that the given role or the text's own marker names; ``NONE`` without."""
    named = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), "(?i)" + MARKER, 1))
    numbers = F.create_map(*[F.lit(x) for name, r in SPEAKERS.items() for x in (name, ROLES.index(r))])
    return F.coalesce(F.try_element_at(numbers, F.lower(F.trim(role))), F.try_element_at(numbers, named), F.lit(NONE))


def features_of(text: Column, position: Column) -> Column:
    """The features of a line in one number, the first of ``FEATURES`` lowest."""
    t = F.coalesce(text, F.lit(""))
    length = F.least(F.greatest(F.floor(F.log2(F.length(t) + 1)).cast("int") - 4, F.lit(0)), F.lit(FEATURES["length"] - 1))
    parts = {
        "length": length,
        "question": F.rlike(t, F.lit(r"\?\s*$")).cast("int"),
        "items": F.rlike(t, F.lit(r"(?m)^\s*(?:[-*•]|\d+[.)]|```)")).cast("int"),
        "paragraphs": F.least(F.regexp_count(F.trim(t), F.lit(r"\n")), F.lit(FEATURES["paragraphs"] - 1)),
        "first": F.coalesce(position == 0, F.lit(False)).cast("int"),
    }
    code, scale = F.lit(0), 1
    for name, values in FEATURES.items():
        code, scale = code + parts[name] * scale, scale * values
    return code.cast("int")


def split_features(codes: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    for name, values in FEATURES.items():
        yield name, codes % values
        codes = codes // values


@dataclass(frozen=True)
class SpeakerModel:
    """Logarithms: ``start[role]``, ``step[role, next]``, ``emit[feature][role, value]``."""

    start: np.ndarray
    step: np.ndarray
    emit: dict[str, np.ndarray]

    def scores(self, markers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The logarithm of each line's observation under each role."""
        out = np.zeros((len(markers), len(ROLES)))
        for name, values in split_features(codes):
            out += self.emit[name][:, values].T
        known = markers < NONE
        out[known] += np.log(DOUBT / 2)
        out[np.flatnonzero(known), markers[known]] += np.log(1 - DOUBT) - np.log(DOUBT / 2)
        return out

    def matrix(self, scores: np.ndarray) -> np.ndarray:
        """The best score of the lines from each role before them (``START``: none) to each at the end."""
        best = np.vstack([self.step, self.start[None, :]]) + scores[0][None, :]
        for row in scores[1:]:
            best = (best[:, :, None] + self.step[None, :, :]).max(axis=1) + row[None, :]
        return best

    def decode(self, scores: np.ndarray, before: int, end: int) -> np.ndarray:
        """The best roles of the lines between given ends."""
        n = len(scores)
        best, back = (self.start if before == START else self.step[before]) + scores[0], np.zeros((n, len(ROLES)), dtype=np.int64)
        for i in range(1, n):
            ways = best[:, None] + self.step
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + scores[i]
        out = np.full(n, end, dtype=np.int64)
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def joined(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of consecutive blocks."""
    best = matrices[0]
    for m in matrices[1:]:
        best = (best[:, :, None] + m[None, : len(ROLES), :]).max(axis=1)
    return best


def ends(matrices: list[np.ndarray], before: int, end: int) -> list[tuple[int, int]]:
    """The roles before and at the end of each of consecutive blocks, on the best way between given ends."""
    best, back = matrices[0][before], []
    for m in matrices[1:]:
        ways = best[:, None] + m[: len(ROLES), :]
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    stops = [end]
    for b in reversed(back):
        stops.append(int(b[stops[-1]]))
    stops.reverse()
    return list(zip([before, *stops[:-1]], stops, strict=True))


def transcript_lines(transcripts: DataFrame, conv_id: str = "conv_id", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text)`` of whole transcripts: a new line of the table begins at each line
    with a speaker marker and after each blank line."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"\n(?=\s*\n)|\n(?=(?i:" + MARKER.removeprefix("^") + "))")
    cleaned = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")
    each = transcripts.select(F.col(conv_id), F.posexplode(cleaned).alias("turn", "text"))
    return each.select(conv_id, F.col("turn").cast("long"), F.lit(None).cast("string").alias("role"), "text")


def transcribed(lines: DataFrame, shown: Column, role: str = "role", text: str = "text") -> DataFrame:
    """Turns with roles as the lines of a transcript: the speaker's marker before the text where ``shown``
    is true and the role a known one, and no role but in ``given_role``, to compare with."""
    name = F.lower(F.trim(named(role)))
    marker = F.when(shown & name.isin(*SPEAKERS), F.concat(F.initcap(name), F.lit(": ")))
    body = F.concat(F.coalesce(marker, F.lit("")), F.coalesce(named(text), F.lit("")))
    own = [c for c in lines.columns if c.lower() not in {role.lower(), text.lower(), "given_role"}]
    return lines.select(*[named(c) for c in own], named(role).alias("given_role"), body.alias(text))


def count_model(blocks: DataFrame) -> SpeakerModel:
    """Count the model from all lines with a marker; the counts that reach the driver are of fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, step = np.zeros(len(ROLES)), np.zeros((len(ROLES), len(ROLES)))
        emit = {name: np.zeros((len(ROLES), n)) for name, n in FEATURES.items()}
        for batch in batches:
            for first, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                markers, codes = _arrays(lines)
                if first and markers[0] < NONE:
                    start[markers[0]] += 1
                pair = (markers[:-1] < NONE) & (markers[1:] < NONE)
                np.add.at(step, (markers[:-1][pair], markers[1:][pair]), 1)
                known = markers < NONE
                for name, values in split_features(codes[known]):
                    np.add.at(emit[name], (markers[known], values), 1)
        flat = np.concatenate([start, step.ravel(), *(emit[name].ravel() for name in FEATURES)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["place", "n"])

    counted = blocks.select("conv", F.col("block") == 0, "lines").mapInArrow(run, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n"))
    size = len(ROLES) + len(ROLES) ** 2 + sum(len(ROLES) * n for n in FEATURES.values())
    flat = np.zeros(size)
    for r in counted.collect():
        flat[r.place] = r.n
    step = flat[len(ROLES) : len(ROLES) * (len(ROLES) + 1)].reshape(len(ROLES), -1)
    for r in _steps_between(blocks):
        step[r.a, r.b] += r.n
    # One case of each kind is added; without data, conversations start with a user and alternate.
    start = flat[: len(ROLES)] + np.array([0.5, 1.0, 0.25])
    step = step + np.array([[0.1, 1, 0.5], [0.1, 0.25, 1], [0.1, 1, 0.25]])
    emit, at = {}, len(ROLES) * (len(ROLES) + 1)
    for name, n in FEATURES.items():
        emit[name] = flat[at : at + len(ROLES) * n].reshape(len(ROLES), n) + 1
        at += len(ROLES) * n
    log_rows = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    return SpeakerModel(log_rows(start), log_rows(step), {k: log_rows(v) for k, v in emit.items()})


def _steps_between(blocks: DataFrame) -> list:
    """How often marked lines follow each other across blocks: ``(a, b, n)``, at most one for each two
    roles and level. Blocks are paired within groups, then the groups like blocks."""
    level = blocks.select("conv", "block", F.element_at("lines", 1)["marker"].alias("first"), F.element_at("lines", -1)["marker"].alias("last"))
    found = []
    while not level.where("block > 0").isEmpty():
        part = F.struct(F.col("block").alias("part"), "first", "last")
        groups = level.groupBy("conv", F.floor(F.col("block") / BLOCK).cast("long").alias("block")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
        groups = stored(groups, "edges")
        n = F.size("parts") - 1
        pairs = F.zip_with(F.slice("parts", 1, n), F.slice("parts", 2, n), lambda x, y: F.struct(x["last"].alias("a"), y["first"].alias("b")))
        found += groups.select(F.inline(pairs)).where(f"a < {NONE} AND b < {NONE}").groupBy("a", "b").agg(F.count("*").alias("n")).collect()
        level = groups.select("conv", "block", F.element_at("parts", 1)["first"].alias("first"), F.element_at("parts", -1)["last"].alias("last"))
    return found


def _arrays(lines: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x["marker"] for x in lines], dtype=np.int64), np.array([x["code"] for x in lines], dtype=np.int64)


def _by_block(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Rows of ``function(row)`` for each row of ``df``."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for values in zip(*[c.to_pylist() for c in batch.columns], strict=True) for r in function(dict(zip(names, values, strict=True)))]
            yield pa.RecordBatch.from_pylist(rows, out)

    out = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def numbered(lines: DataFrame) -> DataFrame:
    """``lines(conv, at, mark, ...)``, all different, with ``n``: how many lines of the conversation come before.

    Each range of the sorted lines counts for itself. Of each range its first and last line reach the driver,
    which adds up how much of a range's first conversation stands in the ranges before.
    """
    order = ["conv", "at", "mark"]
    schema = StructType([*lines.schema.fields]).add("part", IntegerType()).add("run", LongType()).add("n", LongType()).add("ends", BooleanType())
    conv_at = lines.columns.index("conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run, n, last, held = TaskContext.get().partitionId(), -1, 0, None, None

        def made(batch: pa.RecordBatch, runs: list[int], places: list[int], ends: bool) -> pa.RecordBatch:
            size = batch.num_rows
            new = [pa.array([part] * size, pa.int32()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array([False] * (size - 1) + [ends])], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield made(*held, False)
            runs, places = [], []
            for conv in batch.column(conv_at).to_pylist():
                if run < 0 or conv != last:
                    last, run, n = conv, run + 1, 0
                runs.append(run)
                places.append(n)
                n += 1
            held = (batch, runs, places)
        if held:
            yield made(*held, True)

    parts = stored(lines.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "numbered")
    edges = parts.where("run = 0 AND n = 0 OR ends").select("part", "run", "n", "conv", "ends").collect()
    more, before = {}, None
    for r in sorted(edges, key=lambda r: (r.part, r.run, r.n)):
        if r.run == 0 and r.n == 0:
            more[r.part] = before[1] if before and before[0] == r.conv else 0
        if r.ends:
            before = (r.conv, r.n + 1 + (more[r.part] if r.run == 0 else 0))
    added = lines.sparkSession.createDataFrame([(p, m) for p, m in more.items() if m], "of int, more bigint")
    found = parts.join(F.broadcast(added), (F.col("part") == F.col("of")) & (F.col("run") == 0), "left")
    return found.select(*lines.columns, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))


def recover_roles(lines: DataFrame, conv_id: str = "conv_id", position: str = "turn", role: str | None = "role", text: str = "text") -> DataFrame:
    """``lines`` with ``speaker``, the role recovered (without a column of roles from the texts alone), ``starts_turn`` (another role spoke before),
    ``is_first`` and ``is_last`` (of its conversation)."""
    away, back = aside([c for c in lines.columns if c.lower() not in NEW])
    at, body, said_by = named(position), named(text), F.lit(None).cast("string") if role is None else named(role)
    mark = F.xxhash64(F.coalesce(said_by, F.lit("\x00")), F.coalesce(body, F.lit("\x00")))
    keyed = lines.select(
        *away,
        named(conv_id).alias("_conv"),
        F.coalesce(at.cast("long"), F.lit(-1)).alias("_at"),
        mark.alias("_mark"),
        marker_of(said_by, body).alias("_marker"),
        features_of(body, at).alias("_code"),
    )
    coded = keyed.select(*[F.col(f"_{c}").alias(c) for c in ("conv", "at", "mark", "marker", "code")])
    # Equal lines are one.
    coded = coded.groupBy("conv", "at", "mark").agg(F.min("marker").alias("marker"), F.min("code").alias("code"))
    placed = numbered(coded).withColumn("block", F.floor(F.col("n") / BLOCK).cast("long"))
    gathered = placed.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("n", "at", "mark", "marker", "code"))).alias("lines"))
    blocks = stored(gathered, "lines")
    model = count_model(blocks)

    kind = lines.schema[conv_id].dataType.simpleString()
    schema = f"conv {kind}, block bigint, matrix {_MATRIX}"
    shape = (len(ROLES) + 1, len(ROLES))

    def summed(row: dict) -> list[dict]:
        return [{"conv": row["conv"], "block": row["block"], "matrix": model.matrix(model.scores(*_arrays(row["lines"]))).ravel().tolist()}]

    def merged(row: dict) -> list[dict]:
        return [{"conv": row["conv"], "block": row["block"], "matrix": joined([np.array(x["matrix"]).reshape(shape) for x in row["parts"]]).ravel().tolist()}]

    def grouped(level: DataFrame) -> DataFrame:
        return level.groupBy("conv", F.floor(F.col("block") / BLOCK).cast("long").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("block").alias("part"), "matrix"))).alias("parts")
        )

    levels = [stored(_by_block(blocks, summed, schema), "matrices")]
    while levels[-1].where("block > 0").limit(1).count():
        levels.append(stored(_by_block(grouped(levels[-1]), merged, schema), "matrices"))

    def whole(row: dict) -> list[dict]:
        end = int(np.array(row["matrix"]).reshape(shape)[START].argmax())
        return [{"conv": row["conv"], "block": row["block"], "before": START, "end": end, "closes": True}]

    def handed(row: dict) -> list[dict]:
        found = ends([np.array(x["matrix"]).reshape(shape) for x in row["parts"]], row["before"], row["end"])
        last = len(found) - 1
        return [
            {"conv": row["conv"], "block": x["part"], "before": b, "end": e, "closes": row["closes"] and i == last}
            for i, (x, (b, e)) in enumerate(zip(row["parts"], found, strict=True))
        ]

    def with_ends(df: DataFrame, fixed: DataFrame) -> DataFrame:
        same = df["conv"].eqNullSafe(fixed["conv"]) & (df["block"] == fixed["block"])
        return df.join(fixed, same).select(df["*"], "before", "end", "closes")

    ended = f"conv {kind}, block bigint, before int, end int, closes boolean"
    fixed = _by_block(levels[-1], whole, ended)
    for level in reversed(levels[:-1]):
        fixed = stored(_by_block(with_ends(grouped(level), fixed), handed, ended), "ends")

    def decoded(row: dict) -> list[dict]:
        lines, before = row["lines"], row["before"]
        roles = model.decode(model.scores(*_arrays(lines)), before, row["end"]).tolist()
        last = len(lines) - 1
        return [
            {"conv": row["conv"], "at": x["at"], "mark": x["mark"], "speaker": ROLES[r], "starts_turn": r != p, "is_first": p == START, "is_last": row["closes"] and i == last}
            for i, (x, r, p) in enumerate(zip(lines, roles, [before, *roles[:-1]], strict=True))
        ]

    said = _by_block(with_ends(blocks, fixed), decoded, f"conv {kind}, at bigint, mark bigint, speaker string, starts_turn boolean, is_first boolean, is_last boolean")
    same = keyed["_conv"].eqNullSafe(said["conv"]) & (keyed["_at"] == said["at"]) & (keyed["_mark"] == said["mark"])
    return keyed.join(said, same, "left").select(*back, *NEW)


def render(lines: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` of ``recover_roles`` with ``rendered``: a conversation's values, one after the other in the
    order of its lines, are its canonical form. The line's own marker is taken off."""
    said = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "(?i)" + MARKER, "")
    opening = F.concat(F.lit("<|im_start|>"), F.col("speaker"), F.lit("\n"))
    closing = F.lit("<|im_end|>\n")
    before = F.when(~F.col("starts_turn"), F.lit("\n")).when(F.col("is_first"), opening).otherwise(F.concat(closing, opening))
    return lines.withColumn("rendered", F.concat(before, said, F.when(F.col("is_last"), closing).otherwise(F.lit(""))))
