"""License notices over several paragraphs, lines or sentences of a longer text."""

import textwrap

from tidemark.llm import licenses


def test_notices_inside_long_texts(spark):
    pad = "\n".join(f"line {i} of other content that has nothing to do with it" for i in range(200))
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        notice = "\n\n".join(textwrap.fill(x, 40) for x in text.replace(". ", ".\0").split("\0"))
        for k, doc in enumerate((f"{pad}\n\n{notice}\n\n{pad}", f"First some words. {text} Then more words follow here. " + " ".join(f"pad{j}" for j in range(400)))):
            rows.append((2 * i + k, doc))
            want[2 * i + k] = (name, name, True)
    rows += [(1000, pad), (1001, f"{pad} licensed under no terms."), (1002, "One. Released under the MIT License. Two words. Licensed under CC BY 4.0. Three.")]
    want |= {1000: ("", None, False), 1001: ("", None, False), 1002: ("CC-BY-4.0,MIT", "MIT", True)}
    got = {r.doc_id: (r.licenses, r.best_license, (r.best_dice or 0) >= (1 if r.doc_id % 2 else 0.8)) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
