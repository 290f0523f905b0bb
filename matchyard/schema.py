"""Field names, value lists and thresholds that the operators share."""

from __future__ import annotations

# Names and numbers that results depend on.
TYPES = ("fondation", "poutre", "mur_refend", "colonne", "dalle")
STATUSES = ("compliant", "non_compliant", "missing", "added", "needs_review")
BAR_SIZES = ("10M", "15M", "20M", "25M", "30M", "35M")
INCH_MM, FOOT_MM = 25.4, 304.8
SPACING_TOLERANCE_MM = 1.0
TRUST_FOR_VERDICT, ANOMALY_ESCALATES, PROBABILITY_ESCALATES = 0.7, 0.8, 0.6
PEER_GROUP, PEER_MODE_SHARE, PEER_RARE_SHARE = 8, 0.6, 0.1
BAND_K, BAND_FLOOR, BAND_SAMPLES, BAND_FIXED = 6.0, 0.05, 20, (0.8, 1.3)
SNAPPED_FACTOR, DERIVED_FACTOR, FAILED_FACTOR, FAILED_FLOOR = 0.9, 0.8, 0.85, 0.3
ANCHOR_FACTORS = {"outline": 1.0, "label": 0.95, "mark_axis": 0.8, "text_only": 0.5}
NEAR_COLUMN_LIMIT = 0.5

PEER_FIELDS = ("count", "size", "tie_size", "spacing_mm")
