"""Notices count in the score beside a tag, but for the labels that its expression names."""

import pytest
from palimpsest.llm import licenses


@pytest.mark.parametrize(
    ("text", "score"),
    [
        ("SPDX-License-Identifier: MIT\nMozilla Public License", 0.7),
        ("SPDX-License-Identifier: MIT OR MPL-2.0\nMozilla Public License", 0.95),
        ("SPDX-License-Identifier: MIT AND\nMozilla Public License", 0.7),
        ("SPDX License Identifier MIT\nMozilla Public License", 0.7),
        ("SPDX-License-Identifier: MIT AND", 0.5),
    ],
)
def test_score(text, score):
    assert licenses.scan(text)[-1] == score
