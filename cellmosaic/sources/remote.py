"""Catalogues and files over HTTP: manifests by search, downloads that end whole or not at all, remote sizes. Standard library only.

These run on the driver, or in tasks through ``download_all``; what they leave behind are local files or files of a folder that all machines share.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmosaic.schema import MANIFEST

CHUNK, TIMEOUT = 1 << 20, 60


def search(url: str, collection: str, box: tuple[float, float, float, float], assets: tuple[str, ...], limit: int = 1000) -> list[dict]:
    """Items of a STAC collection in a box, all pages: rows ``item_id, asset_key, asset_href`` of the wanted assets, sorted by item and asset."""
    body: dict | None = {"collections": [collection], "bbox": list(box), "limit": limit}
    rows, seen = [], set()
    while body is not None:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            page = json.load(answer)
        for item in page.get("features", []):
            for key in assets:
                if key in item["assets"] and (item["id"], key) not in seen:
                    seen.add((item["id"], key))
                    rows.append({"item_id": item["id"], "asset_key": key, "asset_href": item["assets"][key]["href"]})
        link = next((x for x in page.get("links", []) if x.get("rel") == "next"), None)
        body = None if link is None else {**(body if link.get("merge", True) else {}), **link.get("body", {})}
        url = link["href"] if link else url
    return sorted(rows, key=lambda r: (r["item_id"], r["asset_key"]))


def manifest(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(rows, MANIFEST)


def remote_size(url: str) -> int:
    """Bytes by a HEAD request; -1 where that fails or says nothing."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT) as answer:
            return int(answer.headers.get("Content-Length", -1))
    except (urllib.error.URLError, ValueError, OSError):
        return -1


def remote_sizes(urls: list[str], threads: int = 16) -> dict[str, int]:
    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(urls, pool.map(remote_size, urls), strict=True))


def _once(url: str, path: str, check: Callable[[str], bool] | None) -> None:
    part = f"{path}.{os.getpid()}.part"
    try:
        with urllib.request.urlopen(url, timeout=TIMEOUT) as answer, open(part, "wb") as f:
            said, n = answer.headers.get("Content-Length"), 0
            while data := answer.read(CHUNK):
                n += len(data)
                f.write(data)
        if said is not None and n != int(said):
            raise OSError(f"{url}: {n} of {said} bytes")
        if check and not check(part):
            raise OSError(f"{url}: unreadable")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)


def download(url: str, path: str, tries: int = 4, wait: float = 5.0, check: Callable[[str], bool] | None = None, absent: tuple[int, ...] = ()) -> str | None:
    """The file at ``path``, downloaded unless it is there. A failed try is repeated after ``wait`` seconds, twice that, and so on. None for the HTTP codes ``absent``."""
    if os.path.exists(path):
        return path
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    for k in range(1, tries + 1):
        try:
            _once(url, path, check)
            return path
        except urllib.error.HTTPError as problem:
            if problem.code in absent:
                return None
            last: Exception = problem
        except (urllib.error.URLError, OSError) as problem:
            last = problem
        if k < tries:
            time.sleep(wait * k)
    raise last


def cover_tile(base: str, name: str, folder: str, **more) -> str | None:
    """One land-cover tile; None where there is no land, and so no file."""
    return download(f"{base.rstrip('/')}/{name}.tif", f"{folder}/{name}.tif", absent=(404,), **more)


def download_all(manifest: DataFrame, folder: str, tasks: int = 16, **more) -> DataFrame:
    """Downloads the parsed manifest's files (``tile, period, band, path, asset_href``) below a folder that all machines share; ``path, ok, note`` of each. A file that fails doesn't stop the others."""

    def fetch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    download(r["asset_href"], f"{folder}/{r['path']}", **more)
                    rows.append((r["path"], True, ""))
                except Exception as problem:
                    rows.append((r["path"], False, f"{type(problem).__name__}: {problem}"))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.string()), strict=True)], ["path", "ok", "note"])

    return manifest.select("path", "asset_href").repartition(tasks, "path").mapInArrow(fetch, "path string, ok boolean, note string")


def inventory(spark: SparkSession, parsed: DataFrame, folder: str, check: Callable[[str], bool] | None = None, sizes: bool = True) -> DataFrame:
    """The parsed manifest with ``exists, size_bytes, remote_bytes, intact``: what is below ``folder`` now. A manifest has some thousand rows."""
    found = [r.asDict() for r in parsed.collect()]
    remote = remote_sizes([r["asset_href"] for r in found]) if sizes else {}
    rows = []
    for r in found:
        path = f"{folder}/{r['path']}"
        there = os.path.exists(path)
        size, far = os.path.getsize(path) if there else 0, remote.get(r["asset_href"], -1)
        rows.append({**r, "exists": there, "size_bytes": size, "remote_bytes": far, "intact": there and (far < 0 or size >= far) and (check is None or check(path))})
    from cellmosaic.schema import INVENTORY

    return spark.createDataFrame(rows, INVENTORY).orderBy("tile", "period", "band")


def repair(todo: DataFrame, folder: str, **more) -> DataFrame:
    """Downloads again what ``repair_list`` names: the old files go first."""
    for r in todo.select("path").collect():
        if os.path.exists(f"{folder}/{r['path']}"):
            os.remove(f"{folder}/{r['path']}")
    return download_all(todo.withColumn("path", F.col("path")), folder, **more)
