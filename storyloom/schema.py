"""Schemas of the records."""

from __future__ import annotations

EVENT = (
    "id string, description string, action_type string, time string, location string, actors array<string>, patients array<string>, "
    "why_factors array<string>, chapter int, seq long, confidence double, quote string"
)
PRODUCTION = "event_id string, event_seq long, ord int, entity_id string, entity_name string, entity_type string, relationship string, strength double, agent_type string, theory string"
LINK = "src string, dst string, relation string, mechanism string, weight double, confidence double, theory string, directionality string, edge_supertype string"
SCENE = (
    "scene string, chapter int, ids array<string>, location string, time string, participants array<string>, theme string, summary string, "
    "confidence double, actors array<string>, patients array<string>, reasons array<string>"
)
NOTE = "id string, theme string, involvement string, role string, evidence string, signals string, confidence double"
NODE = "uid string, label string, properties map<string,string>"
EDGE = "start string, end string, type string, properties map<string,string>"
PASSAGE = "text string, embedding array<float>"
