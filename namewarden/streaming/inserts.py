"""Names that arrive in a stream are added to a versioned table once, whatever is rerun.

Names are told apart by keyed state while the watermark holds them, and by the
table itself after that. Each micro-batch is one version; the batch's number is
published with it, so a batch that is rerun after a failure finds itself done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from namewarden.operators.durable import cut
from namewarden.sources.versions import Versions, add_packages


def first_seen(names: DataFrame, time: str, key: str = "package_name", late: str = "1 day") -> DataFrame:
    """Each name's first row within the watermark; a name isn't given again while its state is kept."""
    return names.filter(F.col(key).isNotNull()).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def unseen(table: Versions, names: DataFrame) -> DataFrame:
    """The names that the table doesn't have, looked for in their own buckets only."""
    return names.select(table.key).distinct().join(table.named(names).select(table.key), table.key, "left_anti")


def added(names: DataFrame, table: Versions, embed: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, dims: dict[str, int] | None = None, then: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A writer that embeds and adds the names of a stream that the table lacks.

    ``name`` names the stream in the table: it and ``checkpoint`` belong
    together. The time of a row is that of its batch's first run. ``then`` is
    called with each batch after its version is published, and may be called
    again for a batch that is rerun.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = cut(batch)  # read once and whole, also when it is done, so that the state of the names is kept
        if number > table.manifest()["streams"].get(name, -1):
            now = batch.sparkSession.sql("SELECT cast(current_timestamp() AS string) AS t").first().t
            add_packages(table, unseen(table, batch), embed, now, dims, stream=name, batch=number)
        if then is not None:
            then(batch, number)

    return names.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
