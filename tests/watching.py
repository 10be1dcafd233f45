"""Waiting for a stream of saves."""

import re


def look_of(offset):
    """An offset as progress shows it: one number."""
    return int(re.fullmatch(r"\W*look\W*(\d+)\W*", str(offset))[1])


def caught_up(query):
    """Waits until what is there now has been looked at: a look may be under way at the first call."""
    query.processAllAvailable()
    query.processAllAvailable()
