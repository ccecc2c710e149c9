"""Weekdays and course slots of the timetable queries."""

from __future__ import annotations

# Weekday names and the five course slots of a timetable.
DAY_NAMES = {"Mon": "Lundi", "Tue": "Mardi", "Wed": "Mercredi", "Thu": "Jeudi", "Fri": "Vendredi", "Sat": "Samedi"}
SLOTS = [  # (slot name, first minute of day, end minute)
    ("08h30_10h00", 510, 600),
    ("10h15_11h45", 615, 705),
    ("12h00_13h30", 720, 810),
    ("13h45_15h15", 825, 915),
    ("15h30_17h00", 930, 1020),
]
