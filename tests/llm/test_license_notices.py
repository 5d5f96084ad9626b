"""Short, wrapped and joined notices, from lines written down here and not taken from TEMPLATES."""

import pytest
from pyspark.sql import functions as F

from shelfstar.llm import licenses
from tests.llm.conftest import sentence

SHORT = [("All rights reserved.", ["all-rights-reserved"]), ("(c) 2019 A. Body. ALL RIGHTS RESERVED", ["all-rights-reserved"]), ("MIT License", ["MIT"]),
         ("The MIT License (MIT)", ["MIT"]), ("Apache License 2.0", ["Apache-2.0"]), ("// SPDX-License-Identifier: GPL-3.0-or-later", ["GPL-3.0"]),
         ("# SPDX-License-Identifier: MIT", ["MIT"]), ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
         ("all rights of the reserved table", []), ("permission was granted", []), ("er kommt mit der license nummer", [])]
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify\r
# it under the terms of the GNU General Public License as published by\r
# the Free Software Foundation"""
LONG = [(MIT, ["MIT"]), (BSD, ["BSD-3-Clause"]), (GPL, ["GPL-3.0"]), (MIT.replace(" ", "\n"), ["MIT"]),
        ("This work is available under MIT or Apache: Licensed under the Apache License, Version 2.0. Released under the MIT License.", ["Apache-2.0", "MIT"]),
        (MIT.replace("obtaining a copy\n", "obtaining a copy\n\n"), []), (MIT[:60], [])]


@pytest.fixture(scope="module")
def model(spark):
    import random
    rng = random.Random(1)
    return licenses.fit(spark, spark.createDataFrame([(f"{sentence(rng, 12)} the terms of the public under a version {i}",) for i in range(200)], "text string"))


def test_short_wrapped_and_joined_notices(spark, model, rng):
    cases = [(f"{sentence(rng, 8)}\n{t}\n{sentence(rng, 8)}", f) for t, f in SHORT + LONG]
    cases += [(" ".join([sentence(rng, 700), t.replace("\n", " "), sentence(rng, 30)]), f) for t, f in SHORT[:9] + LONG[:5]]
    cases += [(" ".join([sentence(rng, 300), MIT.replace("\n", " "), sentence(rng, 300), BSD.replace("\n", " "), SHORT[0][0]]), ["BSD-3-Clause", "MIT", "all-rights-reserved"])]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"), model).collect()}
    assert [(t, got[i]["licenses"]) for i, (t, _) in enumerate(cases)] == [(t, f) for t, f in cases]
    at = len(SHORT)  # MIT between two lines of prose
    assert (got[at]["n_paragraphs"], got[at]["n_confirmed"]) == (5, 2) and got[0]["n_confirmed"] == 1


def test_whole_lines_of_the_documents(spark):
    from shelfstar.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"] for r in docs.where(F.col("text").rlike(r"(?m)^All rights reserved\.$")).collect()}
    got = {r["doc_id"] for r in QUERIES["op6_license_scan"](spark, sf).collect() if "all-rights-reserved" in r["licenses"]}
    assert want and want <= got
