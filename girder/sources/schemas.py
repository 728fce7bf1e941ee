"""Explicit schemas of the panel and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: The columns of a snapshot file with their types.
SNAPSHOT_FILE = """project_id string, data_provenance string, project_name string, highway_number string, state string, project_type string, project_status string,
contractor string, reporting_month string, planned_start_date date, planned_completion_date date, planned_duration_months int, months_since_start int,
project_length_km double, original_contract_value_inr_cr double, planned_physical_progress_pct double, actual_physical_progress_pct double,
physical_progress_variance_pct double, planned_financial_progress_pct double, actual_financial_progress_pct double, financial_progress_variance_pct double,
actual_expenditure_inr_cr double, expenditure_variance_pct double, planned_expenditure_inr_cr double, planned_cost_to_date_inr_cr double,
actual_cost_to_date_inr_cr double, material_cost_inr_cr double, labour_cost_inr_cr double, equipment_cost_inr_cr double, delay_related_cost_inr_cr double,
variation_cost_inr_cr double, land_acquisition_delay_days double, utility_shifting_delay_days double, environment_clearance_delay_days double,
material_delay_days double, labour_shortage_days double, traffic_diversion_delay_days double, design_change_delay_days double, approval_delay_days double,
equipment_unavailability_days double, weather_disruption_days double, contractor_productivity_factor double, final_delay_days int, significant_delay int,
final_cost_overrun_pct double, cost_overrun int"""
PROJECT_COLUMNS = ["data_provenance", "project_name", "highway_number", "state", "project_type", "contractor", "planned_start_date", "planned_completion_date", "planned_duration_months", "project_length_km", "original_contract_value_inr_cr"]
CHUNK_FILE = "chunk_id string, document_id string, source_filename string, provenance_type string, page_number int, section_heading string, extraction_method string, extraction_quality_flag string, chunk_index int, chunk_word_count int, chunk_text string"


def names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.replace("\n", " ").split(",")]


def require_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, if no column is missing."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows
