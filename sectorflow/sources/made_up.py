"""Made-up services, for queries and tests of the readers: a URL's answer, without a network."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlparse

RECORDS, HOURS = 2350, 48


def records(url: str) -> str:
    """A page of made-up records, as a service would answer."""
    q = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
    a, n = int(q["$offset"]), int(q["$limit"])
    hour = lambda k: f"2024-{1 + (RECORDS - 1 - k) // 672:02d}-{1 + (RECORDS - 1 - k) % 672 // 24:02d}T{(RECORDS - 1 - k) % 24:02d}:00:00"
    return json.dumps([{"id": k, "half": k / 2, "incident_id": f"r{k // 2}", "published_date": hour(k)} for k in range(a, min(a + n, RECORDS))])


def payload(url: str) -> str:
    """Hourly values of a place: the latitude and the hour, 100 more in a forecast; one place has no answer."""
    at = urlparse(url)
    lat = float(parse_qs(at.query)["latitude"][0])
    if lat == 31.5:
        return "{}"
    times = [f"2024-01-{1 + h // 24:02d}T{h % 24:02d}:00" for h in range(HOURS)]
    return json.dumps({"hourly": {"time": times, "temperature_2m": [lat + h + 100 * at.path.endswith("forecast") for h in range(HOURS)]}})
