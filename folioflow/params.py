"""Constants of the engine, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Geometry and limits on which results depend.
    ocr_min_chars: int = 30
    heading_base_level: int = 4
    heading_max_level: int = 6
    heading_min_height: float = 10.0
    row_tolerance: float = 3.0
    paragraph_left_tolerance: float = 4.0
    paragraph_gap_factor: float = 1.6
    paragraph_right_edge: float = 0.85
    overlap_owner: float = 0.60
    vector_raster_overlap: float = 0.25
    header_band: float = 0.08
    footer_band: float = 0.93
    header_min_pages: int = 3
    header_min_chars: int = 4
    list_indent: float = 18.0
    table_top: float = 0.15
    table_bottom: float = 0.85
    grid_tolerance: float = 3.0
    merged_ratio: float = 0.30
    glued_ratio: float = 0.05
    glued_chars: float = 18.0
    header_cell_chars: int = 90
    outline_lines: int = 15
    outline_scan: int = 40
    site_min_pages: int = 3
    error_chars: int = 2000
    job_limit: int = 500
    long_clause: int = 240


PARAMS = Params()
