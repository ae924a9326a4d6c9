"""Record types, label sets and the JSON schemas of model responses."""

from __future__ import annotations

from pyspark.sql import types as T

# Label sets and generation dimensions.
ALERT_TYPES = [
    "discrimination",
    "sexual_harassment",
    "severe_harassment",
    "bullying",
    "workplace_violence",
    "threat_of_violence",
    "coercive_threat",
    "safety_hazard",
    "retaliation",
    "substance_abuse_at_work",
    "data_breach",
    "security_incident",
    "fraud",
    "corruption",
    "quid_pro_quo",
    "ethics_violation",
    "mental_health_crisis",
    "pattern_of_unfair_treatment",
    "workload_burnout_risk",
    "management_concern",
    "interpersonal_conflict",
    "professional_misconduct",
    "inappropriate_language",
    "profanity",
    "suggestive_language",
    "mental_wellbeing_concern",
    "physical_safety_concern",
]
# Generation order of the alert labels (three broad labels are left out).
GENERATED_ALERT_TYPES = [
    "discrimination",
    "sexual_harassment",
    "severe_harassment",
    "bullying",
    "workplace_violence",
    "threat_of_violence",
    "coercive_threat",
    "safety_hazard",
    "retaliation",
    "substance_abuse_at_work",
    "data_breach",
    "security_incident",
    "fraud",
    "corruption",
    "quid_pro_quo",
    "ethics_violation",
    "mental_health_crisis",
    "pattern_of_unfair_treatment",
    "workload_burnout_risk",
    "mental_wellbeing_concern",
    "physical_safety_concern",
    "profanity",
    "suggestive_language",
    "inappropriate_language",
]
NON_ALERT_TYPES = [
    "performance_complaint",
    "quality_complaint",
    "workload_feedback",
    "process_improvement",
    "resource_request",
    "general_dissatisfaction",
    "constructive_feedback",
    "positive_feedback",
    "neutral_comment",
    "unclear",
]
GENERATED_NON_ALERT_TYPES = NON_ALERT_TYPES[:-1]
SEVERITIES = ["low", "moderate", "high", "critical"]
EXAMPLE_TYPES = ["alert", "non_alert", "mixed", "hard_non_alert", "hard_alert"]
INDUSTRIES = [
    "tech startup",
    "corporate finance",
    "healthcare hospital",
    "manufacturing factory",
    "retail store",
    "restaurant kitchen",
    "law firm",
    "construction site",
    "university",
    "government agency",
    "nonprofit organization",
    "call center",
    "warehouse logistics",
    "advertising agency",
    "pharmaceutical company",
]
ROLES = [
    "junior employee",
    "senior manager",
    "intern",
    "contractor",
    "executive",
    "HR representative",
    "team lead",
    "remote worker",
    "part-time employee",
    "new hire (first week)",
    "long-tenured employee (10+ years)",
]
TONES = [
    "angry venting",
    "calm and factual",
    "passive-aggressive",
    "scared and uncertain",
    "dismissive/minimizing",
    "casual/joking",
    "formal complaint",
    "desperate plea",
    "matter-of-fact",
    "sarcastic",
]
WRITING_STYLES = [
    "formal email",
    "casual slack message",
    "survey response",
    "text message style with typos",
    "run-on sentences",
    "bullet points",
    "very brief (under 20 words)",
    "detailed narrative (100+ words)",
    "ESL speaker patterns",
    "heavy slang/colloquialisms",
]
DIFFICULTIES = [
    "obvious - clear and explicit",
    "subtle - requires reading between lines",
    "ambiguous - could go either way",
    "buried - hidden in normal content",
    "minimized - speaker downplays severity",
    "coded language - uses euphemisms",
]
DEMOGRAPHICS = [
    "young woman",
    "older man",
    "person of color",
    "LGBTQ+ individual",
    "person with disability",
    "immigrant worker",
    "pregnant employee",
    "religious minority",
    "veteran",
    "unspecified/neutral",
]
DIMENSIONS = {
    "industry": INDUSTRIES,
    "role": ROLES,
    "tone": TONES,
    "writing_style": WRITING_STYLES,
    "difficulty": DIFFICULTIES,
    "demographic": DEMOGRAPHICS,
}

# Fixed value: what a failed row carries.
PARSE_FAILED = "PARSE_FAILED"


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in pairs])


_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()

ALERT_SPAN = _fields(("excerpt", _S), ("reasoning", _S), ("alert_type", _S), ("severity", _S))
ALERTS_OUTPUT = _fields(
    ("has_alerts", _B),
    ("alerts", T.ArrayType(ALERT_SPAN)),
    ("non_alert_classification", _S),
    ("non_alert_reasoning", _S),
)
TASK = _fields(
    ("task_id", _L),
    ("example_type", _S),
    *[(name, _S) for name in DIMENSIONS],
    ("alert_types", T.ArrayType(_S)),
    ("non_alert_type", _S),
)
EXAMPLE_METADATA = _fields(
    ("example_type", _S),
    ("expected_alert_types", T.ArrayType(_S)),
    ("expected_non_alert_type", _S),
    *[(name, _S) for name in DIMENSIONS],
)
EXAMPLE = _fields(("text", _S), ("metadata", EXAMPLE_METADATA))
TRAINING_PAIR = _fields(("input", _S), ("output", _S))

_NULLABLE_STRING = {"anyOf": [{"type": "string"}, {"type": "null"}], "default": None}

ALERTS_OUTPUT_SCHEMA = {
    "title": "AlertsOutput",
    "type": "object",
    "required": ["has_alerts", "alerts"],
    "properties": {
        "has_alerts": {"type": "boolean"},
        "alerts": {"type": "array", "items": {"$ref": "#/$defs/AlertSpan"}},
        "non_alert_classification": {
            "anyOf": [{"type": "string", "enum": NON_ALERT_TYPES}, {"type": "null"}],
            "default": None,
        },
        "non_alert_reasoning": _NULLABLE_STRING,
    },
    "$defs": {
        "AlertSpan": {
            "type": "object",
            "required": ["excerpt", "reasoning", "alert_type", "severity"],
            "properties": {
                "excerpt": {"type": "string"},
                "reasoning": {"type": "string"},
                "alert_type": {"type": "string", "enum": ALERT_TYPES},
                "severity": {"type": "string", "enum": SEVERITIES},
            },
        }
    },
}
GENERATED_EXAMPLE_SCHEMA = {
    "title": "GeneratedExample",
    "type": "object",
    "required": ["text"],
    "properties": {"text": {"type": "string"}},
}
REWRITE_SCHEMA = {
    "title": "SyntheticComment",
    "type": "object",
    "required": ["rewritten_comment"],
    "properties": {"rewritten_comment": {"type": "string"}},
}
