"""Published notices, alone and inside longer paragraphs."""

from pyspark.sql import functions as F

from thicket.llm import licenses

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_published_notices(spark):
    inside = f"First some words about this file. {GPL} And then more of them, which are not about licences."
    df = spark.createDataFrame([(1, BSD), (2, GPL), (3, MPL), (4, ISC), (5, inside)], "doc_id long, text string")
    kept = {1: {"BSD-conditions", "BSD-source"}, 2: {"GPL-3.0-header"}, 3: {"MPL-2.0-notice"}, 4: {"ISC-grant"}}
    plain = {r.doc_id: set(r.licenses) for r in licenses.scan(df, sentences=False).collect()}
    assert plain == kept | {5: set()}
    found = {r.doc_id: set(r.licenses) for r in licenses.scan(df.withColumn("best", F.lit(0))).collect()}
    assert found[5] == {"GPL-3.0-header"} and all(kept[i] <= found[i] for i in kept)
