"""Writing contents: one row for each recording, one folder for each format."""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import formats

LOG = logging.getLogger(__name__)

#: Formats with their file endings.
ENDINGS = {"json": ".json", "markdown": ".md", "text": ".txt", "srt": ".srt"}


def contents(entries: DataFrame, meta: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    return {"json": formats.json_rows(entries, meta, raw), "markdown": formats.markdown(entries, meta, raw), "text": formats.plain_text(entries, meta, raw), "srt": formats.subtitles(entries)}


def save_all(entries: DataFrame, meta: DataFrame, raw: DataFrame, folder: str) -> dict[str, str]:
    """Write all formats below ``folder``, partitioned by recording; existing ones are replaced."""
    out = {}
    for kind, df in contents(entries, meta, raw).items():
        out[kind] = f"{folder.rstrip('/')}/{kind}"
        df.repartition("video_id").write.mode("overwrite").partitionBy("video_id").option("lineSep", "\0").text(out[kind])
    return out


def save_files(df: DataFrame, folder: str, kind: str, suffix: str = "") -> int:
    """One file for each recording in a folder that the driver sees; rows arrive one partition at a time."""
    where, n = Path(folder), 0
    where.mkdir(parents=True, exist_ok=True)
    for row in df.select("video_id", "content").toLocalIterator():
        (where / f"{row['video_id']}{suffix}{ENDINGS[kind]}").write_text(row["content"], encoding="utf-8")
        n += 1
    return n


def auto_save(entries: DataFrame, meta: DataFrame, raw: DataFrame, folder: str) -> dict[str, int]:
    """``<recording>_transcript`` in all formats but subtitles, as :func:`save_files`; what fails is logged and left out."""
    saved = {}
    for kind, df in contents(entries, meta, raw).items():
        if kind != "srt":
            try:
                saved[kind] = save_files(df, folder, kind, "_transcript")
            except OSError as error:
                LOG.warning("%s isn't saved: %s", kind, error)
    return saved


def download(contents_: dict[str, DataFrame], kind: str, video_id: object | None = None) -> DataFrame:
    """name, content of one recording, or of all, in a format."""
    if kind not in contents_:
        raise ValueError(f"no such format: {kind}")
    df = contents_[kind] if video_id is None else contents_[kind].filter(F.col("video_id") == video_id)
    return df.select(F.concat(F.col("video_id").cast("string"), F.lit(f"_transcript{ENDINGS[kind]}")).alias("name"), "content")


def target(output: str | None, video: str, kind: str) -> str:
    """Where a single output goes: a path as it is, else beside the recording; ``all`` goes to a folder."""
    path = Path(video)
    if kind == "all":
        if output is None:
            return str(path.parent / path.stem)
        return str(Path(output).parent if Path(output).suffix else Path(output))
    return output or str(path.with_suffix(ENDINGS[kind]))
