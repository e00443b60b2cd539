"""What a running engine counts, in the text format that monitoring systems read."""

from __future__ import annotations

from bisect import bisect_left

QUALITY = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Histogram:
    def __init__(self, bounds: tuple[float, ...]):
        self.bounds, self.counts, self.total, self.n = bounds, [0] * (len(bounds) + 1), 0.0, 0

    def observe(self, value: float, times: int = 1) -> None:
        self.counts[bisect_left(self.bounds, value)] += times
        self.total += value * times
        self.n += times


class Meters:
    """Counters, gauges and histograms of one driver; their number is fixed."""

    def __init__(self) -> None:
        self.counters: dict[str, float] = dict.fromkeys(("faces_detected", "faces_rejected", "classifier_trainings", "prototype_updates"), 0.0)
        self.identifications = dict.fromkeys(("classifier", "prototype", "unknown"), 0.0)
        self.gauges: dict[str, float] = dict.fromkeys(("persons_known", "clusters_total", "classifier_persons"), 0.0)
        self.histograms = {"identify_latency_seconds": Histogram(SECONDS), "frame_latency_seconds": Histogram(SECONDS), "face_quality": Histogram(QUALITY)}

    def rows(self) -> list[tuple[str, str, float]]:
        """(metric, label, value) of every series."""
        out = [(f"{k}_total", "", v) for k, v in self.counters.items()] + [("identifications_total", f'source="{k}"', v) for k, v in self.identifications.items()] + [(k, "", v) for k, v in self.gauges.items()]
        for name, h in self.histograms.items():
            upto = 0
            for bound, n in zip((*h.bounds, float("inf")), h.counts, strict=True):
                upto += n
                out.append((f"{name}_bucket", f'le="{"+Inf" if bound == float("inf") else bound}"', float(upto)))
            out += [(f"{name}_sum", "", h.total), (f"{name}_count", "", float(h.n))]
        return out

    def text(self) -> str:
        return "".join(f"{name}{'{' + label + '}' if label else ''} {value:g}\n" for name, label, value in self.rows())
