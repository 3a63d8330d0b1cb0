"""Schemas of the tables that stages hand on."""

from __future__ import annotations

REGION_SIGNAL = "clip string, frame_idx int, t double, region string, r double, g double, b double, pixel_count int"
INTERVAL = "clip string, region string, start_t double, end_t double"
WINDOW = "segment string, clip string, index int, t_start double, t_end double, abs_start double, region_mask array<boolean>"
SAMPLE = "segment string, fps float, regions array<struct<name:string,valid:boolean,r:array<float>,g:array<float>,b:array<float>,px:array<float>>>"
PPG = "subject string, state string, seq long, value double, ts timestamp"
GROUND_TRUTH = "video string, patient_id string, pulse double, hemoglobin double"
MANIFEST = (
    "segment string, clip string, index int, t_start double, t_end double, abs_start double, patient_id string, pulse double, hemoglobin double, "
    "ppg_file string, ppg_hr double, ppg_start double, ppg_end double, ppg_sampling_frequency double"
)
RESULT = (
    "segment string, clip string, t_start double, t_end double, hr_pos double, conf_pos double, hr_chrom double, conf_chrom double, "
    "hr_green double, conf_green double, hr_label double, hr_pred double, hr_pred_conf double, hb_label double, hb_pred double"
)
