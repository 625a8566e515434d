from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from codeveritas import schemas  # noqa: E402
from codeveritas.session import build_session  # noqa: E402
from codeveritas.sources.files import prepare  # noqa: E402

PY_SAMPLE = '''"""Loads rows."""
import os
import json, numpy as np
from pathlib import Path
from no_such_pkg.inner import thing
from . import local


def fetch(url, timeout):
    """Get it."""
    if url and timeout:
        for part in url.split("/"):
            print(part)  # show
    return os.path.join(url)


async def process(items):
    return [i for i in items if i]


class Loader:
    size: int = 3

    def run(self, a, b=1):
        try:
            with open(a) as f:
                return f.read()
        except OSError:
            return None
'''

JS_SAMPLE = """import React from 'react';
import { a, b } from "no-such-js";
import './local.css';
const apiKey = 'x';
const api_key = "abcdefghij0123456789ABCD";

async function fetchUser(id) {
  const r = await openai.chat.create(id);
  return eval(result);
}
export class App {}
const go = (x) => x;
"""


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def make_files(spark):
    """(path, text) pairs as prepared files of one scan."""

    def make(*pairs, scan="s1", prepared=True):
        rows = [
            (scan, path, len(text.encode("utf-8", "replace")), text) for path, text in pairs
        ]
        df = spark.createDataFrame(rows, schemas.FILES)
        return prepare(df) if prepared else df

    return make
