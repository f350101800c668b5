"""Known texts and spellings of licences, and a caller's own table."""

from helpers import collect, make_documents
from pareframe.llm import licences

BSD_2 = """BSD 2-Clause License

Copyright (c) 2020, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def found(*args):
    return {(r["doc_id"], r["licence"], r["kind"], r["n"]) for r in collect(licences.scan_licences(*args))}


def test_texts_and_spellings(spark):
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE"
    bsd_3 = BSD_2.replace("BSD 2-", "BSD 3-").replace("THIS SOFTWARE", third, 1)
    texts = [BSD_2, bsd_3, bsd_3.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), BSD_2 + "more", licences._UNLICENSE, licences._MIT.replace("sublicense", "sub-licence"), "Licenced under the MIT Licence."]
    expected = {(0, "BSD-2-Clause", "text", 1), (1, "BSD-3-Clause", "text", 1), (2, "BSD-3-Clause", "text", 1), (4, "Unlicense", "text", 1), (5, "MIT", "text", 1), (6, "MIT", "notice", 1)}
    assert found(make_documents(spark, list(enumerate(texts)))) == expected


def test_table_of_the_caller(spark):
    own = spark.createDataFrame([("Beer", "text", "Buy me a beer."), ("Beer", "notice", "Under the beerware terms")], "licence string, kind string, text string")
    rows = [(1, "buy me a BEER"), (2, "x\nunder the beerware terms.\ny"), (3, "Licensed under the MIT License."), (4, None), (5, "")]
    assert found(make_documents(spark, rows), own) == {(1, "Beer", "text", 1), (2, "Beer", "notice", 1)}


def test_folder_of_texts(spark, tmp_path):
    long = "\n\n".join(f"Clause {i}. You may organise and practise this freely." for i in range(300))
    (tmp_path / "Long-1.0.txt").write_text(f"The Long Licence\n\n{long}\n")
    (tmp_path / "Short").write_text("Be kind.")
    rows = [(1, f"THE LONG LICENSE\n(c) 2020 Somebody\n{long.replace('organise', 'organize')}"), (2, "be kind"), (3, long), (4, None)]
    assert found(make_documents(spark, rows), licences.licences_in(spark, str(tmp_path))) == {(1, "Long-1.0", "text", 1), (2, "Short", "text", 1)}
