"""Counters of the streams, and their text form for a metrics scraper."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

#: Observation of a stream and its metric, where that isn't a reason, to the counter's name.
COUNTED = {("ingested", "events"): "events_ingested_total", ("limited", "requests"): "rate_limit_rejections_total", ("refused", "rate"): "rate_limit_rejections_total"}

#: What batches count that a stream's own plan can't observe, by stream and batch; of the last ones.
_NOTED: dict[tuple[str, int], dict[str, dict[str, int]]] = {}


def note(source: str, batch: int, metrics: dict[str, dict[str, int]]) -> None:
    """Metrics by observation of a batch that is being written, for the listeners that hear of its end."""
    _NOTED[source, batch] = metrics
    while len(_NOTED) > 1000:
        del _NOTED[next(iter(_NOTED))]


class Counters(StreamingQueryListener):
    """Adds up what the session's streams observe: events taken, requests refused by reason, requests over the limit, and streams that failed."""

    def __init__(self):
        self.totals: Counter[str] = Counter()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            observed = {name: row.asDict() for name, row in (event.progress.observedMetrics or {}).items()}
            noted = _NOTED.get((f"stream-{event.progress.id}", event.progress.batchId), {}) if event.progress.numInputRows else {}
            for name, metrics in (observed | noted).items():
                for metric, n in metrics.items():
                    if name == "refused":
                        self.totals[f'requests_refused_total{{reason="{metric}"}}'] += n
                    if (name, metric) in COUNTED:
                        self.totals[COUNTED[name, metric]] += n

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.totals["flush_failures_total"] += event.exception is not None

    def text(self, gauges: dict[str, float] | None = None, prefix: str = "sitepulse") -> str:
        """A line for each counter and gauge, with its type before it."""
        with self._lock:
            found = dict.fromkeys((*COUNTED.values(), "flush_failures_total"), 0) | dict(self.totals)
        lines, typed = [], set()
        for kind, values in (("counter", found), ("gauge", gauges or {})):
            for name, value in sorted(values.items()):
                base = f"{prefix}_{name.partition('{')[0]}"
                if base not in typed:
                    typed.add(base)
                    lines.append(f"# TYPE {base} {kind}")
                lines.append(f"{prefix}_{name} {value}")
        return "\n".join(lines) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """The text as the one file of a folder, which any of Spark's stores may hold."""
    spark.createDataFrame([(line,) for line in text.splitlines()], "value string").coalesce(1).write.mode("overwrite").text(path)
