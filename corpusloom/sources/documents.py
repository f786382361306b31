"""The document sink: ordered text files in pieces of bounded size, under each document's own name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.render import BLOCKS
from corpusloom.plans.ranking import with_position

#: Bytes of a piece; a single section that is longer is a piece of its own.
PIECE_BYTES = 64 * 1024 * 1024


def pieces(fragments: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """``project, piece, ord, bytes, markdown``: the fragments of every document, cut into pieces by their bytes.

    The bytes before a fragment in its document decide on its piece, so pieces
    depend on the text alone, not on how it is spread over tasks. Those that begin
    in the same half of ``piece_bytes`` share an even number, unless they are
    longer than a half themselves: such a one has the odd number after it. Pieces
    are in order, though some numbers stay unused.
    """
    half = max(1, piece_bytes // 2)
    sized = fragments.withColumn("bytes", F.octet_length("markdown").cast("bigint"))
    placed = with_position(sized, ["project"], ["key", "line"], "ord", BLOCKS, {"start": "bytes"})
    slot = F.floor(F.col("start") / F.lit(half)) * 2
    piece = F.when(F.col("bytes") > half, slot + 1).otherwise(slot).cast("bigint")
    return placed.select("project", piece.alias("piece"), "ord", "bytes", "markdown")


def write_documents(fragments: DataFrame, outputs: DataFrame, path: str, piece_bytes: int = PIECE_BYTES) -> None:
    """Writes ``<path>/project=<project>/output=<name>/piece=<n>/part-*.txt``.

    ``outputs`` is ``(project, output)``, the name of each project's document
    (``render.output_name``); a project without one gets no document. A document
    is the concatenation of its pieces by number, each a single file, sorted and
    written by one task. The text crosses the network twice: to be numbered and
    to be written.
    """
    placed = pieces(fragments, piece_bytes).join(outputs.select("project", "output"), "project")
    # The partition columns lead the sort, so the writer keeps the order as it is.
    ordered = placed.repartition("project", "output", "piece").sortWithinPartitions("project", "output", "piece", "ord")
    # Every fragment ends in a newline, which the text writer adds itself.
    body = F.expr("left(markdown, length(markdown) - 1)").alias("value")
    ordered.select("project", "output", "piece", body).write.partitionBy("project", "output", "piece").text(path)
