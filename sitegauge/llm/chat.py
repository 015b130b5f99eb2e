"""Chat formatting (7): roles of transcript lines by a hidden Markov model, then canonical turns.

Input rows (conv_id, turn, text) are blocks of raw transcript lines in order of ``turn``. A line may
open with a speaker marker ("User:", "### Assistant:", "[SYSTEM]", "<|ai|>") or have lost it. States
are (role, first line of a turn or a further one). A line is seen as its marker, a length class and
whether it ends in a question mark. ``fit`` counts transitions and emissions in transcripts whose
roles are known; ``recover`` finds the likeliest states by Viterbi and renders turns.

Conversations are decoded in segments of ``SEGMENT`` turn numbers, so one conversation that holds
most rows is still many tasks: each segment is reduced to a matrix of best path weights between
its ends, matrices are combined in a tree, the states at the joints are chosen from the top down,
and then every segment is decoded on its own between known ends.

Null texts count as empty, a null conversation id makes every row a conversation of its own, null
turns come last, equal turns are ordered by hash of their text. Rows that agree in id, turn and
text count once. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitegauge.llm.common import row_key, stored

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role * 2, and one more for further lines
START = STATES
SEGMENT, FAN = 64, 256
_NAMES = {"system": ("system", "instruction"), "user": ("user", "human", "customer"), "assistant": ("assistant", "ai", "bot", "model")}
_MARKER = r"(?i)^\s*(?:###\s*|<\||\[)?\s*(" + "|".join(n for some in _NAMES.values() for n in some) + r")\s*(?:\|>|\]|:)\s*"
_LENGTHS = (0, 20, 40, 80, 160, 320, 640)


def _marker(line: str) -> Column:
    """0 for no marker, else 1 + the number of its role."""
    name = F.lower(F.regexp_extract(line, _MARKER, 1))
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        out = F.when(name.isin(*_NAMES[role]), F.lit(i + 1)).otherwise(out)
    return out


def lines_of(blocks: DataFrame) -> DataFrame:
    """(ck, seg, pos, _h1, _h2, line_no, marker, size, asks, body, conv_id, ...): one row per line."""
    keys = row_key("conv_id", "turn", "text")
    own = [c for c in ("conv_id", "turn", "text", "role") if c in blocks.columns]
    rows = blocks.select(*own, *keys).dropDuplicates(["_h1", "_h2"])
    rows = rows.withColumn("ck", F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("row "), F.col("_h1").cast("string"), F.lit(" "), F.col("_h2").cast("string"))))
    late = F.lit(1 << 51) + F.pmod(F.col("_h1"), F.lit(1024))
    rows = rows.withColumn("seg", F.coalesce(F.floor(F.col("turn") / SEGMENT).cast("long") + (1 << 50), late)).withColumn("pos", F.col("turn").cast("long"))
    cut = rows.select("*", F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("line_no", "line"))
    body = F.regexp_replace("line", _MARKER, "")
    size = sum((F.when(F.char_length("body") > n, 1).otherwise(0) for n in _LENGTHS), F.lit(0))
    return cut.withColumn("marker", _marker("line")).withColumn("body", body).withColumn("size", size).withColumn("asks", F.when(F.col("body").rlike(r"\?\s*$"), 1).otherwise(0))


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities from rows (conv_id, turn, role, text) with a known role; rows of other roles are left out.

    Only counts reach the driver: states by states, and states by values of each feature.
    """
    role = sum((F.when(F.lower(F.col("role").cast("string")) == r, i).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0))
    lines = lines_of(labelled.filter(F.lower(F.col("role").cast("string")).isin(*ROLES)))
    lines = stored(lines.withColumn("state", (2 * role + F.when(F.col("line_no") > 0, 1).otherwise(0)).cast("int")).select("ck", "pos", "_h1", "line_no", "state", "marker", "size", "asks"))

    def table(column: str, values: int) -> np.ndarray:
        out = np.ones((STATES, values))
        for r in lines.groupBy("state", column).count().collect():
            out[r["state"], r[column]] += r["count"]
        return np.log(out / out.sum(1, keepdims=True))

    moves = np.full((STATES + 1, STATES), 1e-3)
    turns = lines.groupBy("ck", "pos", "_h1").agg(F.min("state").alias("first"), F.count("*").alias("n"))
    for r in turns.groupBy("first").agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("more"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("on")).collect():
        moves[r["first"], r["first"] + 1] += r["more"]
        moves[r["first"] + 1, r["first"] + 1] += r["on"]
    one = turns.filter("pos is not null").groupBy("ck", "pos").agg(F.min("first").alias("first"), F.max("n").alias("n"))
    after = one.select("ck", (F.col("pos") - 1).alias("pos"), F.col("first").alias("next"))
    last = F.col("first") + F.when(F.col("n") > 1, 1).otherwise(0)
    for r in one.join(after, ["ck", "pos"]).groupBy(last.cast("int").alias("last"), "next").count().collect():
        moves[r["last"], r["next"]] += r["count"]
    before = one.select("ck", (F.col("pos") + 1).alias("pos")).distinct()
    for r in one.join(before, ["ck", "pos"], "left_anti").groupBy("first").count().collect():
        moves[START, r["first"]] += r["count"]
    for role_no in range(len(ROLES)):  # a further line stays in its turn, and no conversation starts with one
        moves[:, 2 * role_no + 1] *= [1.0 if s in (2 * role_no, 2 * role_no + 1) else 0.0 for s in range(STATES + 1)]
    with np.errstate(divide="ignore"):
        log_moves = np.log(moves / moves.sum(1, keepdims=True))
    return {"moves": log_moves, "marker": table("marker", len(ROLES) + 1), "size": table("size", len(_LENGTHS) + 1), "asks": table("asks", 2)}


FEATURES = ("marker", "size", "asks")


def observed(lines: DataFrame) -> DataFrame:
    """(ck, seg, keys, marker, size, asks): the lines of each segment in order, as arrays."""
    row = F.struct(F.col("pos").isNull().alias("late"), "pos", "_h1", "_h2", "line_no", *FEATURES)
    rows = lines.groupBy("ck", "seg").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    keys = F.transform("rows", lambda r: F.struct(r["_h1"].alias("_h1"), r["_h2"].alias("_h2"), r["line_no"].alias("line_no")))
    return rows.select("ck", "seg", keys.alias("keys"), *[F.expr(f"transform(rows, r -> r.{f})").alias(f) for f in FEATURES])


def emissions(model: dict[str, np.ndarray], *features) -> np.ndarray:
    return sum(model[name][:, np.asarray(values)].T for name, values in zip(FEATURES, features, strict=True))


def path_matrix(model: dict[str, np.ndarray], seen: np.ndarray) -> np.ndarray:
    """Best weight from each state before the first line (or the start) to each state at the last line."""
    out = model["moves"] + seen[0]
    for e in seen[1:]:
        out = (out[:, :, None] + model["moves"][None, :STATES]).max(1) + e
    return out


def best_path(model: dict[str, np.ndarray], seen: np.ndarray, enter: int, leave: int) -> np.ndarray:
    """States of the lines, given the state before them and that of the last."""
    score, back = model["moves"][enter] + seen[0], np.zeros(seen.shape, dtype=np.int64)
    for t in range(1, len(seen)):
        step = score[:, None] + model["moves"][:STATES]
        back[t] = step.argmax(0)
        score = step.max(0) + seen[t]
    path = np.empty(len(seen), dtype=np.int64)
    path[-1] = leave
    for t in range(len(seen) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _joints(model: dict[str, np.ndarray], segments: DataFrame) -> DataFrame:
    """(ck, seg, enter, leave): the states before and at the end of each segment."""
    shape = (STATES + 1, STATES)

    def reduce_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [path_matrix(model, emissions(model, *row)).ravel() for row in zip(*(b[f] for f in FEATURES), strict=True)]
            yield pd.DataFrame({"ck": b["ck"], "seg": b["seg"], "m": made})

    def matrices(group: pd.DataFrame) -> list[np.ndarray]:
        return [np.asarray(m).reshape(shape) for m in group.sort_values("seg")["m"]]

    def combine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        some = matrices(group)
        out = some[0]
        for m in some[1:]:
            out = (out[:, :, None] + m[None, :STATES]).max(1)
        return pd.DataFrame({"ck": [key[0]], "seg": [key[1]], "m": [out.ravel()]})

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group, some = group.sort_values("seg"), matrices(group)
        enter, leave = int(group["enter"].iloc[0]), int(group["leave"].iloc[0])
        score, back = some[0][enter], []
        for m in some[1:]:
            step = score[:, None] + m[:STATES]
            back.append(step.argmax(0))
            score = step.max(0)
        leaves = [leave]
        for b in reversed(back):
            leaves.append(int(b[leaves[-1]]))
        leaves.reverse()
        return pd.DataFrame({"ck": group["ck"].to_numpy(), "seg": group["seg"].to_numpy(), "enter": [enter, *leaves[:-1]], "leave": leaves})

    def choose(whole: DataFrame) -> DataFrame:
        row = F.slice("m", START * STATES + 1, STATES)
        return whole.select("ck", "seg", F.lit(START).alias("enter"), (F.array_position(row, F.array_max(row)) - 1).cast("int").alias("leave"))

    # conversations of one piece are settled at once; only the others go up the tree
    rest = stored(segments.select("ck", "seg", *FEATURES).mapInPandas(reduce_lines, "ck string, seg long, m array<double>"))
    settled, levels = [], []
    while True:
        split_up = stored(rest.groupBy("ck").count().filter("count > 1").select("ck"))
        settled.append(rest.join(split_up, "ck", "left_anti"))
        if split_up.isEmpty():
            break
        levels.append(stored(rest.join(split_up, "ck", "left_semi")))
        parents = levels[-1].withColumn("seg", F.floor(F.col("seg") / FAN).cast("long"))
        rest = stored(parents.groupBy("ck", "seg").applyInPandas(combine, "ck string, seg long, m array<double>"))
    chosen = choose(settled.pop())
    for level in reversed(levels):
        both = level.withColumn("up", F.floor(F.col("seg") / FAN).cast("long")).join(chosen.withColumnRenamed("seg", "up"), ["ck", "up"])
        chosen = choose(settled.pop()).unionByName(stored(both.groupBy("ck", "up").applyInPandas(split, "ck string, seg long, enter int, leave int")))
    return chosen


def recover(blocks: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """conv_id, turn and line at which a turn starts, its role, number of lines, text and rendering."""
    lines = stored(lines_of(blocks))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ends, seen = zip(b["enter"], b["leave"], strict=True), zip(*(b[f] for f in FEATURES), strict=True)
            paths = [best_path(model, emissions(model, *row), enter, leave) for (enter, leave), row in zip(ends, seen, strict=True)]
            starts = [np.maximum.accumulate(np.where(p % 2 == 0, np.arange(len(p)), -1)) for p in paths]
            yield pd.DataFrame({"ck": b["ck"], "seg": b["seg"], "roles": [p // 2 for p in paths], "starts": starts})

    segments = stored(observed(lines))
    known = segments.join(_joints(model, segments), ["ck", "seg"]).select("ck", "seg", "enter", "leave", *FEATURES)
    paths = known.mapInPandas(decode, "ck string, seg long, roles array<int>, starts array<long>")
    zipped = segments.select("ck", "seg", "keys").join(paths, ["ck", "seg"]).select("ck", "seg", F.posexplode(F.arrays_zip("keys", "roles", "starts")).alias("at", "x"))
    states = stored(zipped.select("ck", "seg", "x.keys.*", F.col("at").cast("long").alias("at"), F.col("x.roles").alias("role_no"), F.col("x.starts").alias("start")))
    ends = states.groupBy("ck", "seg").agg(F.max("start").alias("start"))
    earlier = Window.partitionBy("ck").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("ck", "seg", F.last(F.when(F.col("start") >= 0, F.struct(F.col("seg").alias("s"), F.col("start").alias("i"))), ignorenulls=True).over(earlier).alias("open"))
    own = F.struct(F.col("seg").alias("s"), F.col("start").alias("i"))
    placed = states.join(carried, ["ck", "seg"]).withColumn("opened", F.when(F.col("start") >= 0, own).otherwise(F.col("open"))).select("_h1", "_h2", "line_no", "at", "role_no", "opened")
    full = lines.select("conv_id", "ck", "seg", "turn", "_h1", "_h2", "line_no", "body").join(placed, ["_h1", "_h2", "line_no"])
    turns = full.groupBy("ck", "opened").agg(
        F.min("conv_id").alias("conv_id"), F.min("role_no").alias("role_no"), F.count("*").alias("n_lines"),
        F.min(F.struct("seg", "at", "turn", "line_no")).alias("head"), F.sort_array(F.collect_list(F.struct("seg", "at", "body"))).alias("rows"),
    )
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.col("role_no") + 1)
    body = F.array_join(F.transform("rows", lambda r: r["body"]), "\n")
    out = turns.select("conv_id", F.col("head.turn").alias("turn"), F.col("head.line_no").alias("line"), role.alias("role"), "n_lines", body.alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n")))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: markers in four styles, lost from every fourth turn or so.

    The style goes by conversation, the loss by conversation and turn; no row is left out.
    """
    style = F.pmod(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)), F.lit(4))
    name = F.initcap(F.coalesce(F.col("role").cast("string"), F.lit("")))
    marked = (
        F.when(style == 0, F.concat(name, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), name, F.lit(": ")))
        .when(style == 2, F.concat(F.lit("["), F.upper(name), F.lit("] "))).otherwise(F.concat(F.lit("<|"), F.lower(name), F.lit("|> ")))
    )
    lost = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select("conv_id", "turn", "role", F.when(lost | (name == ""), text).otherwise(F.concat(marked, text)).alias("text"))
