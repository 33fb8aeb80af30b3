"""All thresholds in one frozen value that operators take as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Defaults of every operator; `dataclasses.replace` gives variants."""

    min_rows: int = 2
    min_cols: int = 2
    min_numeric_share: float = 0.5
    max_unreadable_share: float = 0.15
    header_period_share: float = 0.5
    header_number_share: float = 0.3
    max_header_rows: int = 3
    max_label_columns: int = 3
    vocabulary_threshold: float = 88.0
    cluster_threshold: float = 95.0
    sum_tolerance: float = 0.005
    product_tolerance: float = 0.02
    absolute_tolerance: float = 1.0
    jump_factor: float = 5.0
    upper_bound: float = 1e9
    min_page_digits: int = 100
    number_format: str = "fr"
    country: str = "NE"
    country_name: str = "Niger"
    agency: str = "GRIDMILL"
    dataflow: str = "DF_OBS"
    version: str = "1.0"
    min_dataset_rows: int = 10
    max_dataset_error_share: float = 0.2


DEFAULT = Options()
