"""Continuous sync: an index that follows a stream of changes to files.

Each micro-batch becomes one generation of the index. The batch's number stands in the same manifest as its
changes, so a batch that is run again after a crash, before or after its generation was published, changes the index
once.

Defined cases: of several rows of a file in a batch the latest by ``mtime`` counts, of equal ones a deletion, then
the largest text; a null text is empty; a null ``deleted`` is false; rows without a path are left out; a batch without rows
only moves the number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .sync import Store

CHANGES = "filepath string, mtime double, text string, deleted boolean"


def whole(changes: DataFrame) -> DataFrame:
    """The rows that count, without nulls but in ``mtime``."""
    return changes.where("filepath is not null").select("filepath", "mtime", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("deleted", F.lit(False)).alias("deleted"))


def latest(changes: DataFrame) -> DataFrame:
    """One row (filepath, mtime, text, deleted) for each file."""
    rows = whole(changes)
    last = rows.groupBy("filepath").agg(F.max(F.struct("mtime", "deleted", "text")).alias("x"))
    return last.select("filepath", "x.mtime", "x.text", "x.deleted")


def take(store: Store, changes: DataFrame, number: int, stream: str = "changes") -> bool:
    """Takes over a batch of changes, if it is later than the last one of its stream; whether it was."""
    done = store.get_state(f"batch:{stream}")
    if done is not None and int(done) >= number:
        return False
    tables = [store.staged(whole(changes), "changes")]
    rows = tables[0]
    # texts move only if some file has several rows, which paths alone tell
    if not rows.groupBy("filepath").count().where("count > 1").isEmpty():
        rows = store.staged(latest(rows), "changes")
        tables.append(rows)
    state = {f"batch:{stream}": str(number)}
    if rows.isEmpty():
        store.set_state(*next(iter(state.items())))
    else:
        files = rows.where("not deleted").select("filepath", "mtime", F.sha2("text", 256).alias("file_hash"), "text")
        store.update(files, rows.where("deleted").select("filepath"), state)
    for table in tables:
        store.drop(table)
    return True


def follow(store: Store, changes: DataFrame, checkpoint: str, stream: str = "changes", **trigger: object) -> StreamingQuery:
    """Starts a query that keeps ``store`` in step with a streaming table of CHANGES; ``trigger`` as Spark's own, ``availableNow=True`` for what is there."""
    writer = changes.writeStream.option("checkpointLocation", checkpoint).queryName(f"follow-{stream}")
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(lambda batch, number: take(store, batch, number, stream) and None).start()
