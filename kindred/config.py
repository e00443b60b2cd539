"""Settings, in sections, with a YAML file laid over the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

# The names and defaults of all settings, section by section, as configuration files have them.


@dataclass
class Detector:
    model_pack: str = "buffalo_l"
    providers: list[str] = field(default_factory=lambda: ["CPUExecutionProvider"])
    det_size: int = 640
    det_score_threshold: float = 0.5


@dataclass
class Quality:
    enabled: bool = True
    min_face_size: float = 60
    min_det_score: float = 0.6
    min_blur_variance: float = 45.0
    max_yaw_asymmetry: float = 2.5


@dataclass
class Tracker:
    enabled: bool = True
    iou_threshold: float = 0.3
    max_age: int = 15
    min_hits: int = 3
    max_embeddings_per_track: int = 30


@dataclass
class Clustering:
    algorithm: str = "hdbscan"
    min_cluster_size: int = 4
    min_samples: int = 2
    dbscan_eps: float = 0.45
    agglomerative_threshold: float = 0.55
    reattach_noise: bool = True
    reattach_threshold: float = 0.45
    purge_outliers: bool = True
    purge_threshold: float = 0.45


@dataclass
class Prototypes:
    enabled: bool = True
    match_threshold: float = 0.60
    ema_alpha: float = 0.10
    path: str = "prototypes"


@dataclass
class Classifier:
    enabled: bool = False
    model: str = "logreg"
    confidence_threshold: float = 0.75
    min_samples_per_person: int = 5
    min_persons: int = 2
    regularization_c: float = 10.0
    mlp_hidden: int = 128
    max_iter: int = 1000
    path: str = "classifier"


@dataclass
class Video:
    frame_stride: int = 3
    display: bool = False


@dataclass
class Acquisition:
    dir: str = "dataset"
    interval_seconds: float = 1.0
    max_frames: int = 0
    max_duration_seconds: float = 0.0
    min_blur_variance: float = 8.0
    capture_width: int = 0
    capture_height: int = 0
    min_change_fraction: float = 0.02
    face_gate: bool = False
    jpeg_quality: int = 95
    display: bool = False


@dataclass
class Schedule:
    capture_start: str = "07:00"
    capture_end: str = "15:00"
    camera: str = "0"
    session_minutes: int = 60
    analysis_enabled: bool = True
    train_after_analysis: bool = False
    retry_seconds: int = 60


@dataclass
class Api:
    host: str = "127.0.0.1"
    port: int = 8000
    embedding_dim: int = 512
    metrics_enabled: bool = True


@dataclass
class Output:
    dir: str = "output"
    save_crops: bool = True
    max_crops_per_cluster: int = 40
    db_path: str = "output/faces"


@dataclass
class Config:
    detector: Detector = field(default_factory=Detector)
    quality: Quality = field(default_factory=Quality)
    tracker: Tracker = field(default_factory=Tracker)
    clustering: Clustering = field(default_factory=Clustering)
    prototypes: Prototypes = field(default_factory=Prototypes)
    classifier: Classifier = field(default_factory=Classifier)
    video: Video = field(default_factory=Video)
    acquisition: Acquisition = field(default_factory=Acquisition)
    schedule: Schedule = field(default_factory=Schedule)
    api: Api = field(default_factory=Api)
    output: Output = field(default_factory=Output)


def load(path: str | None = None) -> Config:
    """Defaults, or a YAML file over them. Unknown keys are passed over; a file that is named must exist."""
    out = Config()
    if path is None:
        return out
    if not Path(path).exists():
        raise FileNotFoundError(path)
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    for section in fields(out):
        own = getattr(out, section.name)
        known = {f.name for f in fields(own)}
        for key, value in (given.get(section.name) or {}).items():
            if key in known:
                setattr(own, key, value)
    return out
