"""Constants of the analysis; every operator takes a Config, so that a deployment can change them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Fixed values of the analysis."""

    regions: tuple[str, ...] = ("forehead", "lcheek", "rcheek")
    # windows
    window_s: float = 20.0
    step_s: float = 15.0
    max_gap_s: float = 1.0
    max_total_gap_s: float = 5.0
    gap_factor: float = 2.0
    min_valid_regions: int = 2
    clip_s: float = 180.0
    fps: float = 30.0
    # signals
    hr_lo_hz: float = 0.9
    hr_hi_hz: float = 2.8
    detrend_lambda: float = 100.0
    filter_order: int = 3
    pos_window_s: float = 1.6
    count_smooth_s: float = 1.0
    min_pixels: int = 80
    support_slack: float = 1.5
    # labels
    hr_min: float = 54.0
    hr_max: float = 168.0
    hb_min: float = 0.0
    hb_max: float = 30.0
    report_min_rows: int = 5
    within_bpm: float = 6.0
    # smoothing of landmarks and masks
    euro_min_cutoff: float = 0.1
    euro_beta: float = 0.005
    euro_d_cutoff: float = 1.0
    mask_threshold: float = 0.5
    erosion_px: int = 3
    # networks
    net_nfft: int = 2048
    net_hr_min: float = 40.0
    net_hr_max: float = 200.0
    readout_bpm: float = 12.0
    target_sigma_bpm: float = 4.0

    @property
    def samples(self) -> int:
        """Samples of a window on the uniform grid."""
        return round(self.window_s * self.fps)


DEFAULT = Config()
