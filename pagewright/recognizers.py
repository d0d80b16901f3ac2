"""The interface for text recognition, a registry, and a recogniser that replays detections from a table.

Recognition itself is not part of this library. An engine is a class with ``load``, ``run`` and ``unload``; it is built once
in each Python worker, and kept there, and an engine that fails gives a row with an error instead of failing the job.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators.catalog import ENGINES
from .schemas import CATALOG


class Recognizer(Protocol):
    name: str
    tier: int
    languages: tuple[str, ...]

    def load(self) -> None: ...

    def run(self, content: bytes, language: str) -> list[tuple[str, float, list[int]]]: ...

    def unload(self) -> None: ...

    def supports_language(self, language: str) -> bool: ...


#: Thresholds that engines are built with.
THRESHOLDS = {"text_det_thresh": 0.5, "text_det_box_thresh": 0.7, "text_rec_score_thresh": 0.5}
#: Options that a build of an engine may lack.
OPTIONAL = ("memory_fraction", "precision", "use_tensorrt", "det_limit_side_len", "limit_side_len")


def options_for(language: str, version: str, s: Settings = Settings(), gpu: bool = False, tensorrt: bool = False, memory: float | None = None) -> dict:
    """What an engine of a language and version is built with; precision and acceleration only where there is a GPU."""
    found: dict = {"lang": language, "ocr_version": version, "device": "gpu" if gpu else "cpu", "use_textline_orientation": True, "use_doc_orientation_classify": False, "use_doc_unwarping": False} | THRESHOLDS
    if gpu and s.effective_precision != "fp32":
        found["precision"] = s.effective_precision
    if gpu and tensorrt:
        found["use_tensorrt"] = True
    if memory is not None:
        found["memory_fraction"] = memory
    if s.side_limit:
        found |= {"det_limit_side_len": s.side_limit, "limit_side_len": s.side_limit}
    return found


def build_with(make: Callable, options: dict):
    """make(**options). If it refuses options by name, once more without those; a missing accelerator module counts as its option."""
    try:
        return make(**options)
    except (TypeError, ValueError, ModuleNotFoundError) as refused:
        told = str(refused)
        named = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", told))
        lacking = {x for x in OPTIONAL if x in options and x in named}
        if isinstance(refused, ModuleNotFoundError) and "tensorrt" in told.lower():
            lacking |= {"use_tensorrt"} & options.keys()
        if not lacking:
            raise
        return make(**{k: v for k, v in options.items() if k not in lacking})


class Engines:
    """The engines of a worker by language, each built at first use: the primary one, and those alternates that can be built."""

    def __init__(self, make: Callable[[str, str], object], table: tuple[tuple[str, int, str], ...] = ENGINES):
        self.make, self.table = make, table
        self._primary: dict[str, object] = {}
        self._alternates: dict[str, list[tuple[str, object]]] = {}

    def primary(self, language: str):
        """None for a language without one."""
        version = next((v for x, o, v in self.table if x == language and o == 0), None)
        if version and language not in self._primary:
            self._primary[language] = self.make(language, version)
        return self._primary.get(language)

    def alternates(self, language: str) -> list[tuple[str, object]]:
        """Those that failed are left out, and not tried again."""
        if language not in self._alternates:
            found = []
            for version in (v for x, o, v in self.table if x == language and o > 0):
                try:
                    found.append((version, self.make(language, version)))
                except Exception:  # noqa: BLE001
                    continue
            self._alternates[language] = found
        return self._alternates[language]


FACTORIES: dict[str, Callable[[], Recognizer]] = {}
_BUILT: dict[str, Recognizer] = {}


def register(name: str, factory: Callable[[], Recognizer]) -> None:
    FACTORIES[name] = factory


def build(name: str, factory: Callable[[], Recognizer] | None = None) -> Recognizer:
    """The worker's own engine of this name, loaded at first use."""
    if name not in _BUILT:
        engine = (factory or FACTORIES[name])()
        engine.load()
        _BUILT[name] = engine
    return _BUILT[name]


def shutdown() -> dict[str, str]:
    """Unloads all engines; errors are returned, not raised."""
    errors = {}
    while _BUILT:
        name, engine = _BUILT.popitem()
        try:
            engine.unload()
        except Exception as e:  # noqa: BLE001
            errors[name] = str(e)
    return errors


def catalog(spark: SparkSession, names: list[str]) -> DataFrame:
    """Every name in order; one that is unknown or does not load keeps its row with the error."""
    rows = []
    for k, name in enumerate(names):
        try:
            engine = build(name)
            rows.append((k, name, engine.tier, list(engine.languages), engine.supports_language("all"), True, None))
        except KeyError:
            rows.append((k, name, None, [], False, False, "unknown model"))
        except Exception as e:  # noqa: BLE001
            rows.append((k, name, None, [], False, False, str(e)))
    return spark.createDataFrame(rows, CATALOG)


OUTPUT = "path string, model string, language string, det_ord int, text string, conf double, x1 int, y1 int, x2 int, y2 int, inference_time_ms double, error string"


def recognize(documents: DataFrame, factory: Callable[[], Recognizer], language: str, name: str | None = None) -> DataFrame:
    """documents: path, content. A row for each line; one row with an error for a document that fails; none for an empty one.

    A worker builds the engine once and keeps it, under ``name`` or else the factory's own, for its later tasks. An engine with a ``flush`` is asked to free memory after
    each document; whether it can makes no difference.
    """
    name = name or f"{factory.__module__}.{getattr(factory, '__qualname__', repr(factory))}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        engine = build(name, factory)
        columns = [c.split()[0] for c in OUTPUT.split(", ")]
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                began = time.perf_counter()
                try:
                    lines = engine.run(bytes(content), language)
                    ms = round((time.perf_counter() - began) * 1000, 2)
                    rows += [(path, engine.name, language, k, t, float(c), *map(int, b), ms, None) for k, (t, c, b) in enumerate(lines)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, engine.name, language, None, None, None, None, None, None, None, 0.0, str(e) or type(e).__name__))
                with contextlib.suppress(Exception):
                    getattr(engine, "flush", lambda: None)()
            yield pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in ("det_ord", "x1", "y1", "x2", "y2")})

    return documents.select("path", "content").mapInPandas(run, OUTPUT)


def replay(documents: DataFrame, detections: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """Stands in for an engine: the stored detections of each document, nothing for a document without."""
    return documents.select(key).join(detections, key).withColumn("model", F.lit(model))
