"""Which elements of a page are meant: tags, classes, ids, attributes, children and descendants."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

# An open element: its tag and attributes.
Element = tuple[str, Mapping[str, str | None]]
Test = Callable[[Element], bool]

_PART = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<class>[\w-]+)|\#(?P<id>[\w-]+)
    |\[\s*(?P<name>[\w:-]+)\s*(?:(?P<how>[~^$*|]?=)\s*(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[\w-]+))\s*)?\]""",
    re.VERBOSE,
)
_STEP = re.compile(r"""\s*(?P<child>>)?\s*(?P<simple>(?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|[^\s>\[,])+)""")

_HOW: dict[str, Callable[[str, str], bool]] = {
    "=": lambda has, wanted: has == wanted,
    "~=": lambda has, wanted: wanted in has.split(),
    "^=": lambda has, wanted: wanted != "" and has.startswith(wanted),
    "$=": lambda has, wanted: wanted != "" and has.endswith(wanted),
    "*=": lambda has, wanted: wanted != "" and wanted in has,
    "|=": lambda has, wanted: has == wanted or has.startswith(f"{wanted}-"),
}


def _attribute(name: str, how: str | None, wanted: str) -> Test:
    def check(element: Element) -> bool:
        if name not in element[1]:
            return False
        return how is None or _HOW[how](element[1][name] or "", wanted)

    return check


def _simple(source: str) -> Test:
    """All conditions on one element, such as ``a.more[href^="/"]``."""
    tests: list[Test] = []
    at = 0
    while at < len(source):
        part = _PART.match(source, at)
        if part is None or (part["tag"] and at):
            raise ValueError(f"Unsupported selector: {source!r}")
        at = part.end()
        if part["tag"]:
            tag = part["tag"].lower()
            tests.append(lambda e, tag=tag: tag in ("*", e[0]))
        elif part["class"]:
            tests.append(_attribute("class", "~=", part["class"]))
        elif part["id"]:
            tests.append(_attribute("id", "=", part["id"]))
        else:
            wanted = next((v for v in (part["double"], part["single"], part["bare"]) if v is not None), "")
            tests.append(_attribute(part["name"].lower(), part["how"], wanted))
    return lambda e: all(test(e) for test in tests)


class Selector:
    """A compiled selector, tested against an element and the stack of elements open around it.

    Supported are lists (``,``), descendants (white space), children (``>``), tags and ``*``,
    ``.class``, ``#id``, ``[name]`` and ``[name=value]`` with ``= ~= ^= $= *= |=``. Anything else is
    a ``ValueError``.
    """

    def __init__(self, source: str):
        self.chains = [self._chain(part) for part in self._parts(source)]

    @staticmethod
    def _parts(source: str) -> list[str]:
        quoted = r"""\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]"""
        parts = [p.strip() for p in re.findall(rf"(?:{quoted}|[^,\[])+|,", source)]
        texts = [p for p in parts if p != ","]
        if not texts or not all(texts) or len(parts) != 2 * len(texts) - 1 or "".join(re.findall(rf"(?:{quoted}|[^,\[])+|,", source)) != source:
            raise ValueError(f"Unsupported selector: {source!r}")
        return texts

    @staticmethod
    def _chain(source: str) -> list[tuple[Test, bool]]:
        """Steps from the element outwards, each with whether the next one out must be its parent."""
        steps: list[tuple[bool, Test]] = []
        at = 0
        while at < len(source):
            step = _STEP.match(source, at)
            if step is None or (step["child"] and not steps):
                raise ValueError(f"Unsupported selector: {source!r}")
            steps.append((bool(step["child"]), _simple(step["simple"])))
            at = step.end()
        return [(test, child) for child, test in reversed(steps)]

    def matches(self, element: Element, above: Sequence[Element]) -> bool:
        return any(chain[0][0](element) and _outwards(chain, 1, above, len(above)) for chain in self.chains)


def _outwards(chain: list[tuple[Test, bool]], step: int, above: Sequence[Element], end: int) -> bool:
    """Do the steps from ``step`` on hold in ``above[:end]``, where the step before was matched behind it?"""
    if step == len(chain):
        return True
    test, parent = chain[step][0], chain[step - 1][1]
    places = [end - 1] if parent and end else range(end - 1, -1, -1) if not parent else []
    return any(test(above[i]) and _outwards(chain, step + 1, above, i) for i in places)
