"""The same operators on a stream of reports."""
