"""Notices that wrap over many lines, repeat in one line, or share a line with another license."""

import pytest

from daybook.llm.license_scan import TEMPLATES, Scan, Templates

CASES = [
    ("\n".join(f"# {w}" for w in TEMPLATES["MIT-grant"].split()), [("MIT-grant", 0, 19, 100)]),
    ("intro released under the mit license middle words released under the mit license end", [("MIT", 0, 0, 100)] * 2),
    ("Released under the MIT License. Released under the MIT License.", [("MIT", 0, 0, 100)] * 2),
    ("Code: Released under the MIT License. Text: Licensed under CC BY-SA 4.0.", [("MIT", 0, 0, 100), ("CC-BY-SA-4.0", 0, 0, 100)]),
    ("x " * 500 + TEMPLATES["Apache-2.0-notice"] + " y" * 500, [("Apache-2.0-notice", 0, 0, 100)]),
    ("Released, with many words put in between by us and others, under the MIT License", [("MIT", 0, 0, 100)]),
    ("nothing of the kind", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_matches(text, want):
    assert Templates(TEMPLATES, Scan()).matches(text) == want
