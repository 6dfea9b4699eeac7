"""Streams of scans: the last MS1 of each file carried over, and a search of files that land in a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINKED = "spec_file string, seq long, spectrum_idx long, ms1_seq long"


class LastMs1(StatefulProcessor):
    """For each MS2 of a file the place of the last MS1 before it, over micro-batches that come in file order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_ms1", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values("seq")
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for seq, level in zip(df.seq, df.ms_level, strict=True):
            if level == 1:
                last = int(seq)
            else:
                out.append((key[0], int(seq), int(seq), last))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["spec_file", "seq", "spectrum_idx", "ms1_seq"]).astype({"ms1_seq": "Int64"})

    def close(self) -> None:
        pass


def linked_stream(scans: DataFrame) -> DataFrame:
    """Streaming scans (spec_file, seq, ms_level) as MS2 rows with ms1_seq."""
    return scans.groupBy("spec_file").transformWithStateInPandas(LastMs1(), outputStructType=LINKED, outputMode="Append", timeMode="None")


def landing_search(spark: SparkSession, folder: str, run: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """A query that searches each batch of mzML files landing in a folder and appends its matches.

    `run` maps spectra to matches; a batch that is tried again writes its own folder again.
    """
    from pyspark.sql import functions as F

    from ..shared import written
    from ..sources.mzml import END, elements, parsed, spectra_of

    text = spark.readStream.option("lineSep", END).option("pathGlobFilter", "*.mzML").text(folder)

    def each(batch: DataFrame, n: int) -> None:
        scans = written(parsed(elements(batch), (2, 2)), "scans")
        run(spectra_of(scans)).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return text.select(F.col("_metadata.file_path").alias("spec_file"), "value").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
