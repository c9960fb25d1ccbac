"""Parameters of an extraction and matching system, and their tag."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Audio:
    fs: int = 8000
    mono: bool = True
    target_rms_dbfs: float = -20.0


@dataclass(frozen=True)
class Pre:
    dc_remove: bool = True
    preemph_alpha: float = 0.97


@dataclass(frozen=True)
class Stft:
    win_len: int = 512
    hop: int = 256
    nfft: int = 512
    window: str = "hamming"


@dataclass(frozen=True)
class Peaks:
    mode: str = "fixed"
    nbhd_f: int = 21
    nbhd_t: int = 21
    density_per_sec: float = 25.0
    band_edges_hz: tuple[float, ...] = (0, 250, 500, 1000, 2000, 4000)
    floor_db: float = -80.0
    kappa_db: float = 6.0


@dataclass(frozen=True)
class Hash:
    fanout: int = 8
    dt_min: int = 1
    dt_max: int = 32
    df_max_bins: int = 64
    freq_decim: int = 1
    freq_bits: int = 9
    dt_bits: int = 14
    query_fanout: int | None = None
    query_dt_max: int | None = None


@dataclass(frozen=True)
class Denoise:
    enable: bool = False
    alpha: float = 2.0
    beta: float = 0.02
    noise_frame_frac: float = 0.10


@dataclass(frozen=True)
class ShortQuery:
    enable: bool = False
    threshold_sec: float = 5.0
    fanout: int = 20
    dt_max: int = 64


@dataclass(frozen=True)
class Match:
    offset_tol: int = 1
    top_k: int = 20
    max_postings: int = 500
    tau: float = 0.02
    rho: float = 1.50


@dataclass(frozen=True)
class Eval:
    lengths_sec: tuple[float, ...] = (3, 5, 10)
    snr_db: tuple[float, ...] = (float("inf"), 10, 5, 0, -5, -10, -15, -20, -25)
    noise_types: tuple[str, ...] = ("cafe", "traffic", "crowd")
    reps_per_song: int = 3
    dev_song_frac: float = 0.20
    energy_gate: float = 0.5


@dataclass(frozen=True)
class Config:
    name: str = "default"
    system: str = ""
    seed: int = 42
    index_layout: str = "csr"
    audio: Audio = field(default_factory=Audio)
    pre: Pre = field(default_factory=Pre)
    stft: Stft = field(default_factory=Stft)
    peaks: Peaks = field(default_factory=Peaks)
    hash: Hash = field(default_factory=Hash)
    denoise: Denoise = field(default_factory=Denoise)
    short_query: ShortQuery = field(default_factory=ShortQuery)
    match: Match = field(default_factory=Match)
    eval: Eval = field(default_factory=Eval)

    @property
    def frame_rate(self) -> float:
        return self.audio.fs / self.stft.hop

    @property
    def bin_width_hz(self) -> float:
        return self.audio.fs / self.stft.nfft

    @property
    def n_bins(self) -> int:
        return self.stft.nfft // 2 + 1

    @property
    def tag(self) -> str:
        return config_tag(self)


def default_config() -> Config:
    return Config()


def baseline_config() -> Config:
    base = default_config()
    return replace(base, name="base", peaks=replace(base.peaks, mode="fixed", nbhd_f=17, nbhd_t=17), match=replace(base.match, tau=0.0267, rho=2.00))


def enhanced_config() -> Config:
    base = baseline_config()
    return replace(
        base,
        name="enh",
        peaks=replace(base.peaks, mode="adaptive", kappa_db=6.0),
        denoise=replace(base.denoise, enable=True, alpha=2.0, beta=0.02, noise_frame_frac=0.10),
        hash=replace(base.hash, fanout=20, dt_max=64, query_fanout=8, query_dt_max=32),
        short_query=replace(base.short_query, enable=True, threshold_sec=5.0, fanout=20, dt_max=64),
        match=replace(base.match, tau=0.0175, rho=1.25),
    )


def _denoise_and_adaptive() -> Config:
    base, full = baseline_config(), enhanced_config()
    return replace(base, name="enh1", peaks=full.peaks, denoise=full.denoise)


def _wide_zone_and_short() -> Config:
    base, full = baseline_config(), enhanced_config()
    return replace(base, name="enh2", hash=full.hash, short_query=full.short_query)


SYSTEMS = {"baseline": baseline_config, "enhanced": enhanced_config, "enh1": _denoise_and_adaptive, "enh2": _wide_zone_and_short}


def system_config(name: str) -> Config:
    """The configuration of a named system; case and outer white space do not matter."""
    key = name.strip().lower()
    if key not in SYSTEMS:
        raise ValueError(f"unknown system {name!r}; known: {', '.join(SYSTEMS)}")
    return replace(SYSTEMS[key](), system=key)


def fnv1a32(data: str | bytes) -> str:
    """FNV-1a with 32 bits as eight hexadecimal digits."""
    h = 2166136261
    for b in data.encode() if isinstance(data, str) else data:
        h = (h ^ b) * 16777619 % (1 << 32)
    return f"{h:08x}"


def extraction_fields(cfg: Config) -> dict:
    """What decides the content of an index; query-side settings do not."""
    kept = ("fanout", "dt_min", "dt_max", "df_max_bins", "freq_decim")
    return {"audio": asdict(cfg.audio), "pre": asdict(cfg.pre), "stft": asdict(cfg.stft), "peaks": asdict(cfg.peaks), "hash": {k: asdict(cfg.hash)[k] for k in kept}}


def config_tag(cfg: Config) -> str:
    mode = {"fixed": "fix", "adaptive": "adp"}.get(cfg.peaks.mode, cfg.peaks.mode.lower())
    body = json.dumps(extraction_fields(cfg), sort_keys=True, separators=(",", ":"))
    return f"{mode}{cfg.peaks.nbhd_f}x{cfg.peaks.nbhd_t}_f{cfg.hash.fanout}_d{cfg.hash.dt_max}_{fnv1a32(body)}"


def config_diff(old: dict, new: dict, path: str = "") -> list[str]:
    """`path (old -> new)` of every field that differs."""
    out = []
    for k in sorted({*old, *new}):
        at = f"{path}.{k}" if path else k
        a, b = old.get(k), new.get(k)
        if isinstance(a, dict) and isinstance(b, dict):
            out += config_diff(a, b, at)
        elif a != b:
            out.append(f"{at} ({a} -> {b})")
    return out


def resolve_query(cfg: Config, seconds: float) -> tuple[int, int, list[str]]:
    """Fan-out and largest time step of a query of some length, and warnings: the short-query override if enabled and the query is shorter than its threshold, else the query override, else the enrolment's."""
    h, warnings = cfg.hash, []
    if cfg.short_query.enable and seconds < cfg.short_query.threshold_sec:
        fanout, dt_max = cfg.short_query.fanout, cfg.short_query.dt_max
    else:
        fanout = h.fanout if h.query_fanout is None else h.query_fanout
        dt_max = h.dt_max if h.query_dt_max is None else h.query_dt_max
    if dt_max > h.dt_max:
        warnings.append(f"dt_max {dt_max} exceeds the index's {h.dt_max} and is lowered to it")
        dt_max = h.dt_max
    if fanout > h.fanout:
        warnings.append(f"fanout {fanout} exceeds the index's {h.fanout}")
    return fanout, dt_max, warnings


def check_compatible(cfg: Config, index_cfg: Config) -> Config:
    """The query configuration with the index's grid; an error if a field that decides hash meaning differs."""
    fields = [("audio", "fs"), ("stft", "win_len"), ("stft", "hop"), ("stft", "nfft"), ("stft", "window"), ("hash", "freq_bits"), ("hash", "dt_bits"), ("hash", "freq_decim"), ("pre", "preemph_alpha")]
    wrong = [f"{a}.{b}" for a, b in fields if getattr(getattr(cfg, a), b) != getattr(getattr(index_cfg, a), b)]
    if wrong:
        raise ValueError(f"query and index differ in {', '.join(wrong)}")
    return replace(cfg, stft=index_cfg.stft, audio=index_cfg.audio, pre=index_cfg.pre)
