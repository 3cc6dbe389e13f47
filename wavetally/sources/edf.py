"""Spark data source ``edf``: recordings by ranges of their data records.

A file is cut into splits of about ``splitBytes``; a task reads the file's header and the
records of its split, and decodes only the channels that are asked for. Option ``kind``:
``chunks`` (samples), ``notes`` (annotations) or ``headers`` (one row a signal; a file that
cannot be read becomes a row with its error). Files are named by local paths or by URIs of any
store that Arrow opens; the driver lists them and reads none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "chunks": "record_id string, label string, chunk_idx int, start_sample long, sample_rate_hz double, values array<double>",
    "headers": "path string, status string, error string, n_records long, record_seconds double, label string, unit string, sample_rate_hz double, n_samples long",
    "notes": "record_id string, onset_s double, duration_s double, label string",
}
#: Width of each field of a signal's header, in order.
FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("physical_min", 8), ("physical_max", 8), ("digital_min", 8), ("digital_max", 8), ("filter", 80), ("samples", 8), ("reserved", 32))
#: Fixed value: what the label of a signal of annotations begins with.
NOTES = "EDF Annotations"


def parse_header(data: bytes) -> dict:
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    if len(data) < 256 or not data[:8].strip().isdigit():
        raise ValueError("not an EDF header")
    out = {"size": int(text(184, 8)), "start": f"{text(168, 8)} {text(176, 8)}", "records": int(text(236, 8)), "seconds": float(text(244, 8)), "signals": int(text(252, 4))}
    n, at = out["signals"], 256
    if len(data) < 256 * (n + 1):
        raise ValueError("the header is cut short")
    for name, width in FIELDS:
        out[name] = [text(at + k * width, width) for k in range(n)]
        at += n * width
    return out


def annotations(blocks: list[bytes]) -> list[tuple[float, float, str]]:
    """(onset, duration, text) of the time-stamped lists; lists without text keep time only."""
    out = []
    for block in blocks:
        for tal in block.split(b"\0"):
            parts = tal.split(b"\x14")
            if len(parts) < 2 or not parts[0]:
                continue
            when, _, length = parts[0].partition(b"\x15")
            out += [(float(when), float(length or 0), p.decode("utf-8", "replace")) for p in parts[1:] if p]
    return out


class Recording:
    """One open file: its header, and any range of its data records."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file = file
        first = file.read_at(256, 0) if size >= 256 else b""
        count = first[252:256].strip()
        signals = int(count) if count.isdigit() else 0
        self.header = parse_header(file.read_at(min(size, 256 * (signals + 1)), 0))
        self.per = np.array([int(s) for s in self.header["samples"]], np.int64)
        self.width = int(self.per.sum())
        whole = (size - self.header["size"]) // (2 * self.width) if self.width else 0
        # A recorder that was cut off leaves the count at -1, or counts records that are not there.
        self.records = int(whole if self.header["records"] < 0 else min(whole, self.header["records"]))

    def rate(self, k: int) -> float:
        return float(self.per[k]) / self.header["seconds"]

    def raw(self, first: int, last: int) -> np.ndarray:
        data = self.file.read_at((last - first) * 2 * self.width, self.header["size"] + first * 2 * self.width)
        return np.frombuffer(data, "<i2").reshape(last - first, self.width)

    def digital(self, raw: np.ndarray, k: int) -> np.ndarray:
        at = int(self.per[:k].sum())
        return raw[:, at : at + int(self.per[k])]

    def microvolts(self, raw: np.ndarray, k: int) -> np.ndarray:
        low, high, dlow, dhigh = (float(self.header[f][k]) for f in ("physical_min", "physical_max", "digital_min", "digital_max"))
        if dlow == dhigh:
            raise ValueError(f"{self.header['label'][k]} has no digital range")
        x = (self.digital(raw, k).ravel().astype(float) - dlow) * (high - low) / (dhigh - dlow) + low
        return x * {"V": 1e6, "mV": 1e3}.get(self.header["unit"][k], 1.0)


@dataclass
class Split(InputPartition):
    uri: str
    size: int
    part: int
    parts: int


class EdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.kind, self.path = options.get("kind", "chunks"), options["path"]
        self.channels = json.loads(options["channels"]) if options.get("channels") else None
        self.rate = float(options["rate"]) if options.get("rate") else None
        self.chunk, self.split = int(options.get("chunk", 60_000)), int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[Split]:
        store, root = pafs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = store.get_file_info(root)
        files = [found] if found.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(root, recursive=True))
        out, scheme = [], self.path.partition("://")[0] if "://" in self.path else "file"
        for f in sorted((f for f in files if f.type == pafs.FileType.File and f.path.endswith(".edf")), key=lambda f: f.path):
            parts = 1 if self.kind == "headers" else max(1, -(-f.size // self.split))
            out += [Split(f"{scheme}://{f.path}" if scheme == "file" else self._uri(root, f.path), f.size, k, parts) for k in range(parts)]
        return out

    def _uri(self, root: str, path: str) -> str:
        return self.path.rstrip("/") + path[len(root.rstrip("/")) :]

    def read(self, split: Split) -> Iterator[tuple]:
        store, path = pafs.FileSystem.from_uri(split.uri)
        with store.open_input_file(path) as file:
            if self.kind == "headers":
                yield from self._headers(file, split)
                return
            recording = Recording(file, split.size)
            first, last = (recording.records * k // split.parts for k in (split.part, split.part + 1))
            name = split.uri.rpartition("/")[2]
            if self.kind == "notes":
                for k in (k for k, label in enumerate(recording.header["label"]) if label.startswith(NOTES)):
                    raw = recording.raw(first, last)
                    yield from ((name, *a) for a in annotations([r.tobytes() for r in recording.digital(raw, k)]))
                return
            yield from self._chunks(recording, name, first, last)

    def _headers(self, file: pa.NativeFile, split: Split) -> Iterator[tuple]:
        try:
            r = Recording(file, split.size)
            h = r.header
            yield from [(split.uri, "ok", None, h["records"], h["seconds"], h["label"][k], h["unit"][k], r.rate(k), int(r.per[k]) * h["records"]) for k in range(h["signals"])]
        except (ValueError, ZeroDivisionError) as e:
            yield (split.uri, "error", str(e), None, None, None, None, None, None)

    def _chunks(self, r: Recording, name: str, first: int, last: int) -> Iterator[tuple]:
        """A split has the chunks that start within its records, and reads on for their ends."""
        for k, label in enumerate(r.header["label"]):
            if label.startswith(NOTES) or (self.channels and label not in self.channels) or not r.per[k]:
                continue
            hz, per = r.rate(k), int(r.per[k])
            if self.rate and abs(hz - self.rate) > 1e-9:
                raise ValueError(f"{name}: {label} has {hz} Hz, not {self.rate}")
            end = r.records * per
            for i in range(-(-first * per // self.chunk), -(-last * per // self.chunk)):
                start, stop = i * self.chunk, min(end, (i + 1) * self.chunk)
                from_, to = start // per, -(-stop // per)
                x = r.microvolts(r.raw(from_, to), k)[start - from_ * per : stop - from_ * per]
                yield (name, label, i, start, hz, x.tolist())


class EdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "chunks")]

    def reader(self, schema) -> EdfReader:
        return EdfReader(dict(self.options))
