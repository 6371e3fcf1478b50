"""Word lists, patterns and thresholds that decide results. Fixed values."""

SEVERITIES = ("critical", "high", "medium", "low", "info")
BASE_PENALTY = {"critical": 20.0, "high": 12.0, "medium": 6.0, "low": 2.0, "info": 0.0}
COLUMN_CAP = 35.0
#: Lowest score, grade, verdict.
GRADES = ((97.0, "A+", "reliable"), (90.0, "A", "reliable"), (75.0, "B", "reliable"), (50.0, "C", "caution"), (30.0, "D", "caution"), (0.0, "F", "compromised"))

STRONG_ID = {"id", "uuid", "guid", "pk", "identifier", "ident"}
KEY_MODIFIERS = {
    "foreign", "fk", "sort", "partition", "group", "routing", "cache", "meta",
    "encryption", "public", "private", "secret", "license", "config", "setting",
}
ENTITIES = {
    "customer", "user", "employee", "emp", "record", "account",
    "client", "vendor", "member", "order", "invoice", "transaction",
    "txn", "entity", "person", "patient", "student", "supplier", "merchant",
    "asset", "serial", "tracking", "unique", "primary", "lookup",
}
FOREIGN_ROLES = {
    "manager", "supervisor", "parent", "agent", "physician", "doctor",
    "attending", "reviewer", "approver", "assigned", "assignee",
    "creator", "author", "owner", "referrer", "sponsor", "broker",
}

TEXT_SENTINELS = ("n/a", "na", "null", "none", "?", "unknown", "-", "--", "missing", "nan", "#n/a", "nil", "undefined", "blank", "none/specified")
NUMERIC_SENTINELS = (9999, 99999, 999999, -1, -999, -9999)
LIFECYCLE = {
    "exit", "exited", "termination", "terminated", "cancel", "cancelled",
    "canceled", "cancellation", "dropout", "resign", "resigned", "offboard", "offboarded",
}
LIFECYCLE_ENDS, LIFECYCLE_DATES = {"term", "end", "leave"}, {"date", "dates", "dt", "time", "timestamp", "datetime"}
BOOLEAN_WORDS = ("true", "false", "0", "1", "yes", "no", "t", "f")

DATE_NAMES = {
    "date", "dates", "time", "datetime", "timestamp", "dt",
    "hire", "hired", "exit", "exited", "birth", "birthdate", "dob",
    "created", "updated", "termination", "promotion",
}
DATE_PATTERNS = (
    ("ISO_8601", r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?:[ T](?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]{1,6})?)?$"),
    ("SLASH_YMD", r"^[0-9]{4}/(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])$"),
    ("SLASH_DMY", r"^(?:0?[1-9]|[12][0-9]|3[01])/(?:0?[1-9]|1[0-2])/[0-9]{4}$"),
    ("SLASH_MDY", r"^(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/[0-9]{2}$"),
    ("DOT_DMY", r"^(?:0?[1-9]|[12][0-9]|3[01])\.(?:0?[1-9]|1[0-2])\.[0-9]{4}$"),
)
#: The look of a date that a column's first values are tested for; the first branch has no end.
DATE_SHAPE = r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|^[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}$"

#: Tokens of a start, tokens of an end that must not precede it, and what the rule says.
TEMPORAL_PAIRS = (
    (
        {"hire", "hired", "join", "joined", "start", "started", "entry", "onboard", "onboarded"},
        {"exit", "exited", "term", "termination", "terminated", "end", "ended", "leave", "resign", "resigned", "offboard", "offboarded"},
        "an end of employment follows its start",
    ),
    (
        {"birth", "birthdate", "dob"},
        {"hire", "hired", "join", "joined", "start", "started", "graduate", "graduated", "graduation", "enroll", "enrolled", "enrollment"},
        "an event of a life follows birth",
    ),
    (
        {"order", "ordered", "booking", "booked", "creation", "created"},
        {"ship", "shipped", "shipping", "shipment", "deliver", "delivered", "delivery", "dispatch", "dispatched", "fulfill", "fulfilled", "fulfillment"},
        "fulfilment follows the order",
    ),
    ({"ship", "shipped", "shipping", "shipment", "dispatch", "dispatched"}, {"deliver", "delivered", "delivery"}, "delivery follows dispatch"),
    ({"admit", "admitted", "admission"}, {"discharge", "discharged"}, "discharge follows admission"),
    ({"enroll", "enrolled", "enrollment"}, {"graduate", "graduated", "graduation"}, "graduation follows enrolment"),
    ({"open", "opened", "opening"}, {"close", "closed", "closing", "resolve", "resolved", "resolution"}, "closing follows opening"),
    ({"pickup", "picked", "collection", "collected"}, {"deliver", "delivered", "delivery", "dropoff"}, "delivery follows pickup"),
    ({"transaction", "txn", "trade"}, {"settle", "settled", "settlement", "clearing", "cleared"}, "settlement follows the trade"),
)
#: Every token of the pairs is temporal, and these.
TEMPORAL_NAMES = {"date", "dates", "time", "datetime", "timestamp", "day", "dt", "updated"}.union(*(a | b for a, b, _ in TEMPORAL_PAIRS))
NON_NEGATIVE = {"count", "quantity", "qty", "items", "age", "days", "hours", "units", "visits", "clicks"}
FINANCIAL_PARTS = ("salary", "revenue", "amount", "cost", "price", "sales", "transaction", "payment", "expense", "balance")

#: What a CSV cell may say instead of a value.
NA_CELLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
