"""Names the test modules share."""

import json

T = 1_700_000_000_000


def message(*spans, service="svc"):
    resource = {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]}
    return json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [s]} for s in spans]}]})
