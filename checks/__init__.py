"""Queries over the test tables, each next to SQL that must give the same rows."""

from checks import cleaning, coverage, matching, profiles, transforms

ALL = (profiles, transforms, cleaning, matching, coverage)
