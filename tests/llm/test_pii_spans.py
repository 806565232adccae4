"""Spans of spelled-out addresses next to line breaks."""

from tidemark.llm import pii


def test_a_line_break_between_name_and_at_shifts_no_span():
    text = "jane\n\nat example dot org and joe at example dot org"
    found = [text[a:b] for kind, a, b in pii.proposals(text, []) if kind == "email"]
    assert found == ["joe at example dot org"]
