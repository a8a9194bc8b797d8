"""What a file of unknown format may hold: readable strings, array shapes, kinds of bytes, records of an index.

All take ``files`` with ``path`` and, but for shapes, ``content``, as Spark's
binary files have them. A file is one value of a row, so it must fit a task;
files without content count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of azimuths and gates that a file may hold; bytes of its header and of a gate; bytes that its size may differ.
AZIMUTHS, GATE_COUNTS, LAYOUTS, SLACK = (360, 720, 1440), (230, 460, 920, 1000), ((1024, 1), (2048, 1), (128, 2)), 2000
#: Header sizes that are tried; bytes that are counted; bytes that decide about the kind.
HEADERS, COUNTED, DECIDING = (0, 128, 256, 512, 1024, 2048, 4096), 100_000, 50_000
#: The scan mode and the product codes that an index record may name, in the order in which they are looked for.
SCAN_MODE, CODES = b"VCP11D", (b"019", b"020", b"026", b"027", b"158", b"160", b"161", b"162")


def strings(files: DataFrame, reach: int = 512, separator: str = "\x00", least: int = 3) -> DataFrame:
    """``path, seq, text``: pieces of the first ``reach`` bytes between separators, stripped, of at least ``least`` bytes with a letter or digit among them; bytes beyond ASCII are shown as U+FFFD."""
    head = F.decode(F.substring("content", 1, reach), "ISO-8859-1")  # a character for each byte
    pieces = files.select("path", F.posexplode(F.split(head, F.lit(f"\\x{ord(separator):02x}"))).alias("seq", "text"))
    stripped = F.regexp_replace("text", r"^[\x09-\x0d\x20]+|[\x09-\x0d\x20]+$", "")
    kept = pieces.withColumn("text", stripped).filter((F.length("text") >= least) & F.col("text").rlike("[A-Za-z0-9]"))
    return kept.withColumn("text", F.regexp_replace("text", r"[\x80-\xff]", "�"))


def shapes(files: DataFrame, least: int = 1024) -> DataFrame:
    """``path, azimuths, gates, header, item_bytes, expected``: arrays that a file of more than ``least`` bytes may hold by its ``length`` alone; contents aren't read."""
    table = [F.struct(F.lit(a).alias("azimuths"), F.lit(g).alias("gates"), F.lit(h).alias("header"), F.lit(b).alias("item_bytes"), F.lit(h + a * g * b).alias("expected")) for a in AZIMUTHS for g in GATE_COUNTS for h, b in LAYOUTS]
    near = F.filter(F.array(*table), lambda s: F.abs(F.col("length") - s["expected"]) < SLACK)
    return files.filter(F.col("length") > least).select("path", F.explode(near).alias("s")).select("path", "s.*")


def byte_kinds(files: DataFrame, counted: int | None = COUNTED, deciding: int | None = DECIDING, least: int = 2000) -> DataFrame:
    """``path, header, zeros, typical, top, kind`` of each header size that leaves a body like pixels: over 30 % zeros among the first ``counted`` bytes and over 20 % of 1 to 200 among the first ``deciding`` (None: all).

    ``top`` lists up to eight commonest bytes, of equal ones the first met first.
    ``kind`` is reflectivity if over 40 % of the deciding bytes are 5 to 75, else
    velocity if over 30 % are less than 30 from the commonest, else null.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                data = np.frombuffer(content or b"", np.uint8)
                for header in HEADERS if len(data) > least else ():
                    body = data[header:]
                    if not len(body):
                        continue
                    seen, head = body[:counted], body[:deciding]
                    n, first = np.bincount(seen, minlength=256), np.full(256, len(seen))
                    np.minimum.at(first, seen, np.arange(len(seen)))
                    m = np.bincount(head, minlength=256)
                    zeros, typical = 100.0 * n[0] / len(seen), 100.0 * m[1:201].sum() / len(head)
                    if zeros <= 30 or typical <= 20:
                        continue
                    order = [int(b) for b in np.lexsort((first, -n)) if n[b]]
                    close = m[max(0, order[0] - 29) : order[0] + 30].sum()
                    kind = "reflectivity" if m[5:76].sum() > 0.4 * len(head) else "velocity" if close > 0.3 * len(head) else None
                    out.append((path, header, zeros, typical, order[:8], kind))
            yield pd.DataFrame(out, columns=["path", "header", "zeros", "typical", "top", "kind"])

    return files.select("path", "content").mapInPandas(decode, "path string, header int, zeros double, typical double, top array<int>, kind string")


def index_records(files: DataFrame, reach: int = 60) -> DataFrame:
    """Records of index files ``.../<station>/<product>/<code>/<file>``; a record starts wherever the station's name stands.

    ``path, station, record, offset, size``, and where in the record it stands
    and what it is: ``mode_at`` of the scan mode, ``code, code_at`` of the first of
    the known codes that occurs, ``name, name_at`` of a file name: ``reach`` bytes
    from a first letter like the station's that hold three underscores. What a
    record lacks is null. Bytes before the first record are left out.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "station", "record", "offset", "size", "mode_at", "code", "code_at", "name", "name_at"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                folders = path.split("/")
                station, data, out = folders[-4] if len(folders) > 3 else "", content or b"", []
                mark = station.encode()
                at = data.find(mark) if mark else -1
                while at >= 0:
                    after = data.find(mark, at + len(mark))
                    entry = data[at : after if after >= 0 else len(data)]
                    mode = entry.find(SCAN_MODE)
                    code = next((c for c in CODES if c in entry), None)
                    name, name_at = None, entry.find(mark[:1])
                    while 0 <= name_at < len(entry) - 30:
                        shown = entry[name_at : name_at + reach].decode("ascii", "ignore")
                        if shown.count("_") >= 3:
                            name = shown.strip("\0").strip()
                            break
                        name_at = entry.find(mark[:1], name_at + 1)
                    out.append((path, station, len(out), at, len(entry), mode if mode >= 0 else None, code and code.decode(), entry.find(code) if code else None, name, name_at if name else None))
                    at = after
                yield pd.DataFrame(out, columns=columns).astype({"mode_at": "Int64", "code_at": "Int64", "name_at": "Int64"})

    return files.select("path", "content").mapInPandas(decode, "path string, station string, record long, offset long, size long, mode_at long, code string, code_at long, name string, name_at long")
