"""All registered queries and their SQL checks by name."""

from kerbline.plans import events, learning, scoring, space_time

QUERIES = {**events.QUERIES, **space_time.QUERIES, **scoring.QUERIES, **learning.QUERIES}
ORACLES = {**events.ORACLES, **space_time.ORACLES, **scoring.ORACLES, **learning.ORACLES}
