"""Options of loading and summarizing: defaults, then a file of properties, then what the caller gives."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from tessella.functions.vocabulary import GENERIC, TYPE, VARIANTS, Vocabulary
from tessella.operators.quotient import KINDS
from tessella.operators.summary import GENERAL, NO_SHORTCUT


@dataclass
class Options:
    """``from_layers`` reads names as they are written here; lists are separated by commas."""

    kind: str = "strong"
    saturation: str = "NONE"  # or ASSERTION_SAT
    saturate_summary: bool = False  # the shortcut: saturate the summary and not the graph
    omit_generic_properties: bool = True
    generic_properties: tuple[str, ...] = GENERIC
    default_type_property: str = TYPE
    variant_type_properties: tuple[str, ...] = VARIANTS
    replace_type_with_most_general_type: bool = False
    consistency_checks: bool = False
    export_tables: bool = True
    export_ntriples: bool = True
    export_representation: bool = False
    export_statistics: bool = True
    export_support_statistics: bool = False  # numbers of nodes and triples as N-Triples of their own
    support: bool = True
    drawing: str = "none"  # plain, split_leaves, split_and_fold_leaves, encoded (numbers), graph (the input) or none
    palette: str = "light"
    png: bool = False  # also as a picture, if there is a dot program
    step_by_step: str = "false"  # always, when_changes or false: draw the summary as the first triples come one by one
    steps: int = 100  # so many of them
    overwrite: bool = False

    @classmethod
    def from_layers(cls, *layers: dict[str, str]) -> Options:
        """Later layers win; an unknown name is an error."""
        kinds = {f.name: type(f.default) for f in fields(cls)}
        told: dict = {}
        for name, value in (x for layer in layers for x in layer.items()):
            if name not in kinds:
                raise ValueError(f"unknown option {name!r}")
            if kinds[name] is bool and not isinstance(value, bool):
                if str(value).lower() not in ("true", "false"):
                    raise ValueError(f"{name} is true or false, and not {value!r}")
                value = str(value).lower() == "true"
            elif kinds[name] is int:
                if not str(value).isdigit():
                    raise ValueError(f"{name} is a number, and not {value!r}")
                value = int(value)
            elif kinds[name] is tuple and isinstance(value, str):
                value = tuple(x.strip() for x in value.split(",") if x.strip())
            told[name] = value
        return cls(**told).checked()

    def checked(self) -> Options:
        wrong = []
        if self.kind not in KINDS:
            wrong.append(f"unknown kind {self.kind!r}")
        if self.saturation not in ("NONE", "ASSERTION_SAT"):
            wrong.append(f"saturation is NONE or ASSERTION_SAT, and not {self.saturation!r}")
        if self.saturate_summary and self.kind in NO_SHORTCUT:
            wrong.append(f"{self.kind} takes no shortcut")
        if self.replace_type_with_most_general_type and self.kind not in GENERAL:
            wrong.append(f"{self.kind} can't generalise types")
        if self.drawing not in ("none", "plain", "split_leaves", "split_and_fold_leaves", "encoded", "graph"):
            wrong.append(f"unknown drawing {self.drawing!r}")
        if self.step_by_step not in ("always", "when_changes", "false"):
            wrong.append(f"step_by_step is always, when_changes or false, and not {self.step_by_step!r}")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def vocabulary(self) -> Vocabulary:
        return Vocabulary(self.default_type_property, self.variant_type_properties, self.generic_properties if self.omit_generic_properties else ())

    def lines(self) -> list[str]:
        """The options in effect, sorted by name."""
        show = lambda v: ",".join(v) if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else v
        return [f"{f.name}={show(getattr(self, f.name))}" for f in sorted(fields(self), key=lambda f: f.name)]

    def prefix(self, out: str, name: str) -> str:
        """Where a summary's files go: the graph's name, whether it was saturated, and the kind's code."""
        saturated = "_sat" if self.saturation != "NONE" or self.saturate_summary else ""
        return f"{out.rstrip('/')}/{name}{saturated}_{KINDS[self.kind].code}"


def properties(path: str) -> dict[str, str]:
    """A file of ``name = value`` lines; # starts a comment."""
    out = {}
    for line in Path(path).read_text().splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            name, _, value = line.partition("=")
            out[name.strip()] = value.strip()
    return out
