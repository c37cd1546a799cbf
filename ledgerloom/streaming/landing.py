"""Continuous intake from a landing folder (Structured Streaming).

The service handles one file per request; at volume, files arrive in a
folder instead. The file stream source tracks which files are new (its
progress lives in the query's checkpoint location, so a restarted or
failed query resumes without re-reading finished files). All CSV and text files
of a micro-batch go through admission, profile, registration and, optionally, the load
into the sales table together, in a number of jobs that does not depend on
theirs (``plans.batch``); workbooks are handled one after the other, and
so are the files of a batch whose common jobs fail, to find the one at fault.

The upload id is derived from the file's path and modification time, so a
micro-batch replayed after a failure re-registers the same id, and the load
guard refuses a second load of a processed upload.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions.constants import STATUS_ERROR, STATUS_PROCESSED, STATUS_UPLOADED
from ledgerloom.operators.uploads import latest_state
from ledgerloom.plans.batch import BATCH_SUFFIXES, run_batch
from ledgerloom.plans.process import process_upload
from ledgerloom.plans.upload import profile_upload
from ledgerloom.sources import registry as R
from ledgerloom.sources.files import suffix

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def upload_id_for(path: str, modified) -> str:
    return hashlib.sha1(f"{path}|{modified}".encode()).hexdigest()[:32]


def new_files(spark: SparkSession, landing_dir: str, max_files: int = 100) -> DataFrame:
    """Stream of newly arrived files (path, modificationTime, length); content is not read."""
    return (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
            .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
            .load(landing_dir).select("path", "modificationTime", "length"))


@dataclass
class _Accepted:
    """What a load needs of an upload that this batch has just profiled."""

    file_path: str
    status: str = STATUS_UPLOADED
    column_mapping: dict | None = None


def handle_batch(spark: SparkSession, batch: DataFrame, registry_path: str,
                 sales_path: str | None, as_of=None) -> list[dict]:
    """Run the upload (and optionally the load) plan for the files of a micro-batch.

    The batch holds one row per new file (at most ``max_files``), so
    collecting it brings file names, not data, to the driver. Uploads that a
    replayed batch finds processed are skipped.
    """
    files = batch.select("path", "modificationTime").collect()
    ids = {upload_id_for(r.path, r.modificationTime): r.path for r in files}
    done: set[str] = set()
    try:
        state = latest_state(R.read_events(spark, registry_path).filter(
            F.col("upload_id").isin(list(ids))))
        done = {r.upload_id for r in state.filter(F.col("status") == STATUS_PROCESSED).collect()}
    except AnalysisException:
        pass                                             # no registry yet
    results = [{"upload_id": uid, "path": path, "status": STATUS_PROCESSED}
               for uid, path in ids.items() if uid in done]
    new = {uid: path for uid, path in ids.items() if uid not in done}
    together = {uid: path for uid, path in new.items() if suffix(path) in BATCH_SUFFIXES}
    if together:
        try:
            results += run_batch(spark, together, registry_path, sales_path, as_of=as_of)
        except Exception:  # noqa: BLE001 - one unreadable file must not stop the others
            together = {}
    single = {uid: path for uid, path in new.items() if uid not in together}
    return results + _one_by_one(spark, single, registry_path, sales_path, as_of)


def _one_by_one(spark: SparkSession, uploads: dict[str, str], registry_path: str, sales_path: str | None,
                as_of) -> list[dict]:
    """The plans of a single file for each of ``uploads``; all events are appended in one write."""
    results, events = [], []
    for uid, path in uploads.items():
        try:
            res = profile_upload(spark, path, upload_id=uid, as_of=as_of, events=events)
            out = {"upload_id": uid, "path": path, "status": res.status,
                   "valid": res.validation["is_valid"]}
            if sales_path and res.validation["is_valid"]:
                out.update(process_upload(spark, registry_path, sales_path, uid, as_of=as_of,
                                          record=_Accepted(path), events=events))
        except Exception as e:  # noqa: BLE001 - one bad file must not stop the intake
            events.append(R.event(uid, STATUS_ERROR, error_message=str(e), file_path=path,
                                  filename=path.rstrip("/").split("/")[-1]))
            out = {"upload_id": uid, "path": path, "status": STATUS_ERROR, "error": str(e)}
        results.append(out)
    R.append_events(spark, registry_path, events)
    return results


def start_intake(spark: SparkSession, landing_dir: str, registry_path: str,
                 checkpoint_location: str, sales_path: str | None = None,
                 available_now: bool = True, max_files: int = 100, as_of=None) -> StreamingQuery:
    """Start the intake query. ``available_now`` processes what is there and stops."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        handle_batch(spark, batch, registry_path, sales_path, as_of)

    writer = (new_files(spark, landing_dir, max_files).writeStream
              .option("checkpointLocation", checkpoint_location).foreachBatch(run))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
