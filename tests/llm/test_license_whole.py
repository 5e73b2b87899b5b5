"""License scan: files with many templates, long prose and changed words."""

from flowpanel.llm import license_scan
from test_rule_operators import frame

PROSE = "Any person may copy the following forms free of charge, subject to the terms granted with or without restriction and use. "


def test_no_template_is_lost_in_a_file_with_many_license_words(spark):
    texts = {label: text for label, text, _ in license_scan.TEMPLATES}
    mit = texts["mit"]
    for w in ("associated", "copy", "deal", "documentation", "files", "obtaining", "person", "restriction"):
        mit = mit.replace(f" {w}", " x")
    rows = [
        (1, ". Filler here. ".join(texts.values()), None),
        (2, PROSE + "Licensed under the Apache License, Version 2.0.", None), (3, PROSE + "Licensed under CC BY 4.0.", None), (4, mit, None),
    ]
    # Words of short notices are common, those of the prose are not.
    rows += [(100 + i, "software licensed under the apache license version 2 0 cc by 4 to this in", None) for i in range(40)]
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1][0] - {"gpl", "cc-by", "reserved"} == set(texts)
    assert got[2] == ({"apache-2.0"}, 1.0) and got[3] == ({"cc-by", "cc-by-4.0"}, 1.0)
    assert got[4] == ({"mit"}, 1 - 8 / len(mit.split()))
