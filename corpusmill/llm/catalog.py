"""All queries of this subpackage, by name."""

from corpusmill.llm import archive, bpe, importance, lexical, maintext, minhash, mixing, nearest, quality, secretscan, substring, toxicity, trainorder  # noqa: F401
from corpusmill.llm.base import ORACLE, QUERIES  # noqa: F401
