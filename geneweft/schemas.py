"""Declared schemas of the tables the library reads and writes."""

from __future__ import annotations

PARAMETERS = "map<string,double>"

NETLIST = (
    "struct<"
    "nodes: array<struct<id: string, node_type: string, gate_name: string, protein: string, "
    "name: string, parameters: map<string,string>>>, "
    "edges: array<struct<source: string, target: string, parameters: map<string,string>>>>"
)

DECISION = (
    "struct<decision: string, error_type: string, selected_index: string, "
    "recommended_ucf: string, feedback: string>"
)

MINED = "map<string, struct<raw_value: string, raw_unit: string, is_empirical: boolean>>"

STIMULUS = "struct<type: string, start: double, duration: double, amp: double, freq: double>"

TRAJECTORY = (
    "design_id bigint, sample_id bigint, state_name string, species string, kind string, "
    "seq bigint, n_points bigint, time double, value double"
)

SERIES = ("design_id", "sample_id", "state_name", "species", "kind")
