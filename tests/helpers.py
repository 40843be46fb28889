import gzip
import json


def event(log="text", decoder=None, rule=None, level=None, agent="001", location="/var/log/secure", at="2026-09-18T09:00:00+00:00", **more):
    e = {"timestamp": at, "agent": {"id": agent, "name": f"a{agent}"}, "location": location, "full_log": log, "decoder": {"name": decoder} if decoder else {}}
    if rule is not None:
        e["rule"] = {"id": rule, "level": level, "description": "d"}
    return e | more


def write(path, rows):
    """NDJSON of events; strings are lines as they are."""
    text = "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return path
