"""Rule set for activity events, in the rule-dictionary form ``validate`` reads."""

# Required and optional paths, types, patterns, allowed values and
# bounds of activity events. Results depend on them.
REQUIRED = [
    "id",
    "type",
    "actor",
    "actor.id",
    "actor.login",
    "repo",
    "repo.id",
    "repo.name",
    "created_at",
]

TYPES = {
    "id": "string",
    "actor.id": "integer",
    "actor.login": "string",
    "repo.id": "integer",
    "repo.name": "string",
    "public": "boolean",
    "created_at": "string",
    "type": "string",
}

NOT_NULL = ["id", "type", "actor.id", "actor.login", "repo.id", "repo.name", "created_at"]
MAY_BE_EMPTY = {"actor.id", "repo.id"}

EVENT_TYPES = [
    "PushEvent",
    "IssuesEvent",
    "IssueCommentEvent",
    "PullRequestEvent",
    "PullRequestReviewEvent",
    "PullRequestReviewCommentEvent",
    "WatchEvent",
    "ForkEvent",
    "CreateEvent",
    "DeleteEvent",
    "ReleaseEvent",
    "MemberEvent",
    "PublicEvent",
    "GollumEvent",
    "CommitCommentEvent",
]

ID_PATTERN = "^[0-9]+$"
LOGIN_PATTERN = "^[a-zA-Z0-9]([a-zA-Z0-9-]{0,37}[a-zA-Z0-9])?$"
REPO_PATTERN = "^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$"
MIN_ID, MAX_ID = 1, 999999999

PAYLOAD_FIELDS = {
    "PushEvent": ["payload.ref", "payload.commits"],
    "IssuesEvent": ["payload.action", "payload.issue"],
    "IssueCommentEvent": ["payload.action", "payload.comment", "payload.issue"],
    "PullRequestEvent": ["payload.action", "payload.pull_request"],
    "ForkEvent": ["payload.forkee"],
    "CreateEvent": ["payload.ref_type"],
}

MAX_FUTURE_SECONDS = 300
MAX_AGE_DAYS = 365
DUPLICATE_LOOKBACK_SECONDS = 3600


def event_rules() -> dict:
    """The complete rule set: 10 + 2 schema, 8 type, 7 null, 6 value, 4 time, 3 consistency, 1 duplicate."""
    return {
        "version": "1.0",
        "event_type": "events",
        "schema": {
            "required_fields": [
                *[{"path": p, "severity": "FAIL"} for p in REQUIRED],
                {"path": "public", "severity": "WARN"},
            ],
            "optional_fields": [
                {"path": "payload", "severity": "WARN"},
                {"path": "org", "severity": "INFO"},
            ],
        },
        "type_checks": [
            {"field": p, "expected_type": t, "severity": "WARN" if p == "public" else "FAIL"}
            for p, t in TYPES.items()
        ],
        "null_checks": [
            {"field": p, "allow_null": False, "allow_empty": p in MAY_BE_EMPTY, "severity": "FAIL"}
            for p in NOT_NULL
        ],
        "value_checks": [
            {"field": "id", "check_type": "regex", "pattern": ID_PATTERN, "severity": "FAIL"},
            {"field": "type", "check_type": "enum", "allowed_values": EVENT_TYPES, "severity": "WARN"},
            {"field": "actor.login", "check_type": "regex", "pattern": LOGIN_PATTERN, "severity": "FAIL"},
            {"field": "repo.name", "check_type": "regex", "pattern": REPO_PATTERN, "severity": "FAIL"},
            *[
                {"field": p, "check_type": "range", "min_value": MIN_ID, "max_value": MAX_ID, "severity": "FAIL"}
                for p in ("actor.id", "repo.id")
            ],
        ],
        "timestamp_checks": [
            {"field": "created_at", "check_type": "format", "severity": "FAIL"},
            {
                "field": "created_at",
                "check_type": "not_future",
                "tolerance_seconds": MAX_FUTURE_SECONDS,
                "severity": "WARN",
            },
            {"field": "created_at", "check_type": "not_too_old", "max_age_days": MAX_AGE_DAYS, "severity": "WARN"},
            {"field": "created_at", "check_type": "parseable", "severity": "FAIL"},
        ],
        "consistency_checks": [
            {
                "name": "payload_structure_matches_event_type",
                "severity": "WARN",
                "rules": [
                    {"if_field": "type", "equals": kind, "then_required": required}
                    for kind, required in PAYLOAD_FIELDS.items()
                ],
            },
            # Names and fields of the two groups.
            {
                "name": "actor_fields_consistent",
                "severity": "FAIL",
                "check_type": "all_or_none",
                "fields": ["actor.id", "actor.login", "actor.url"],
            },
            {
                "name": "repo_fields_consistent",
                "severity": "FAIL",
                "check_type": "all_or_none",
                "fields": ["repo.id", "repo.name", "repo.url"],
            },
        ],
        "duplicate_check": {
            "enabled": True,
            "key_field": "id",
            "lookback_window_seconds": DUPLICATE_LOOKBACK_SECONDS,
            "severity": "FAIL",
        },
    }


def without(rules: dict, *sections: str) -> dict:
    """The rule set less some sections."""
    return {k: v for k, v in rules.items() if k not in sections}


def only(rules: dict, *sections: str) -> dict:
    """The rule set reduced to some sections."""
    return {k: v for k, v in rules.items() if k in (*sections, "version", "event_type")}
