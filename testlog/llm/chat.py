"""Multi-party dialogues, rendered once from the view of every participant.

From a participant's view its own turns are the assistant's and are trained on; all
others are users under their names; the system's turns stay the system's.  Spans tell
which characters of the rendered text belong to the speaker's words and their end mark.

Long dialogues are rendered in parts of ``PART_TURNS`` turn numbers, so that no task holds
a dialogue of any length; parts of one view follow each other by (part, piece).  Where
more than ``PIECE_ROWS`` rows share a part, as with repeated turn numbers, the part is split
by a hash of the rows into pieces.

Defined results: a null text is empty; a null role takes part under the name "unknown";
a null turn comes before all others, in part -1; rows without a dialogue id form one
dialogue; repeated rows are turns of their own; rows of one turn follow the order of
role and text; a dialogue of system turns only has no participants and no view; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from testlog.operators.durable import store

PART_TURNS = 256
PIECE_ROWS = 4096
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

SCHEMA = (
    "conv_id long, speaker string, part long, piece int, text string, n_turns long, n_own long, "
    "spans array<struct<start:long,end:long>>, n_chars long, n_masked long"
)


def render(turns: list[tuple[str, str]], speaker: str) -> tuple[str, list[tuple[int, int]], int]:
    """Text of (role, text) turns from a speaker's view, its trained spans, its own turns."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        if role == speaker:
            head = f"{OPEN}assistant\n"
        elif role == SYSTEM:
            head = f"{OPEN}{SYSTEM}\n"
        else:
            head = f"{OPEN}user name={role}\n"
        pieces.append(f"{head}{text}{CLOSE}\n")
        if role == speaker:
            spans.append((at + len(head), at + len(head) + len(text) + len(CLOSE)))
        at += len(pieces[-1])
    return "".join(pieces), spans, len(spans)


def rotate(turns: DataFrame) -> DataFrame:
    """One row per dialogue, participant, part and piece, with text and spans."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / PART_TURNS).cast("long"), F.lit(-1).cast("long")).alias("part"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62)).cast("long")).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    large = store(
        rows.groupBy("conv_id", "part")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > PIECE_ROWS)
        .select(
            F.col("conv_id").alias("large_id"),
            F.col("part").alias("large_part"),
            F.ceil(F.col("n") / (PIECE_ROWS // 2)).cast("int").alias("pieces"),
        )
    )
    here = F.col("conv_id").eqNullSafe(F.col("large_id")) & (F.col("part") == F.col("large_part"))
    small = rows.join(large, here, "left_anti").withColumn("piece", F.lit(0))
    # equal rows are counted and numbered, so that a repeated task deals them out alike
    copies = rows.join(large, here).groupBy("conv_id", "part", "turn", "role", "text", "pieces").agg(
        F.count("*").alias("n")
    )
    dealt = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(
        "conv_id", "part", "turn", "role", "text",
        F.pmod(F.xxhash64("turn", "role", "text", "copy"), F.col("pieces")).cast("int").alias("piece"),
    )
    dealt = small.unionByName(dealt)
    gathered = store(
        dealt.groupBy("conv_id", "part", "piece").agg(
            F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
        )
    )
    speakers = (
        gathered.select("conv_id", F.explode(F.array_distinct("turns.role")).alias("role"))
        .filter(F.col("role") != SYSTEM)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_set("role")).alias("speakers"))
        .withColumnRenamed("conv_id", "speaker_id")
    )
    views = gathered.join(speakers, F.col("conv_id").eqNullSafe(F.col("speaker_id"))).select(
        "conv_id", "part", "piece", "turns", "speakers"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                turns = [(t["role"], t["text"]) for t in row["turns"]]
                out = []
                for speaker in row["speakers"]:
                    text, spans, own = render(turns, speaker)
                    out.append(
                        {
                            "conv_id": row["conv_id"], "speaker": speaker, "part": row["part"], "piece": row["piece"],
                            "text": text, "n_turns": len(turns), "n_own": own,
                            "spans": [{"start": a, "end": b} for a, b in spans],
                            "n_chars": len(text), "n_masked": sum(b - a for a, b in spans),
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return views.mapInArrow(run, SCHEMA)


_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()), ("speaker", pa.string()), ("part", pa.int64()), ("piece", pa.int32()),
        ("text", pa.string()), ("n_turns", pa.int64()), ("n_own", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("n_chars", pa.int64()), ("n_masked", pa.int64()),
    ]
)
