"""Masked views of nested rows: what a viewer may not see is replaced, wherever in the schema it stands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


@dataclass(frozen=True)
class Mask:
    """What is hidden, and from whom.

    ``path`` names a field from the top: ``scene.notes``, ``turns[].text`` for the elements of an array, ``facts{}`` for
    the values of a map. Viewers of a role in ``roles`` see it, and so does its owner: ``owner`` is a field of the row's
    top (``/party.leader``) or of the innermost struct that holds the masked one. Others see ``instead``.
    """

    path: str
    roles: tuple[str, ...] = ()
    owner: str | None = None
    instead: str | None = None


def _field(of: Column, path: str) -> Column:
    for name in path.split("."):
        of = of.getField(name)
    return of


class _View:
    def __init__(self, masks: Sequence[Mask], role: Column, viewer: Column, top: dict[str, Column]):
        self.masks, self.role, self.viewer, self.top = {m.path: m for m in masks}, role, viewer, top
        self.met: set[str] = set()

    def seen(self, mask: Mask, inside: Column | None) -> Column:
        may = self.role.isin(*mask.roles) if mask.roles else F.lit(False)
        if mask.owner and mask.owner.startswith("/"):
            first, _, rest = mask.owner[1:].partition(".")
            owner = _field(self.top[first], rest) if rest else self.top[first]
        elif mask.owner:
            owner = _field(inside, mask.owner) if inside is not None else self.top[mask.owner]
        else:
            return F.coalesce(may, F.lit(False))
        return F.coalesce(may, F.lit(False)) | F.coalesce(owner.cast("string") == self.viewer.cast("string"), F.lit(False))

    def value(self, value: Column, kind: DataType, path: str, inside: Column | None) -> Column:
        """``value`` as the viewer sees it; ``inside`` is the innermost struct around it."""
        if mask := self.masks.get(path):
            self.met.add(path)
            rest = self.below(value, kind, path, inside)
            return F.when(self.seen(mask, inside), rest).otherwise(F.lit(mask.instead).cast(kind))
        return self.below(value, kind, path, inside)

    def below(self, value: Column, kind: DataType, path: str, inside: Column | None) -> Column:
        if not any(p.startswith(path) and p != path for p in self.masks):
            return value
        if isinstance(kind, StructType):
            fields = [self.value(value.getField(f.name), f.dataType, f"{path}.{f.name}", value).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: self.value(x, kind.elementType, f"{path}[]", inside))
        if isinstance(kind, MapType):
            return F.transform_values(value, lambda _, x: self.value(x, kind.valueType, f"{path}{{}}", inside))
        return value


def masked(df: DataFrame, masks: Sequence[Mask], role: Column, viewer: Column) -> DataFrame:
    """``df`` as viewers see it, in the same columns; ``role`` and ``viewer`` are of the row.

    A null role or viewer sees what nobody owns and no role is needed for. Nulls stay null whoever looks, as far as what
    stands instead is null too. A path that the schema lacks is an error: a mask that hides nothing is a leak.
    """
    top = {f.name: F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema}
    view = _View(masks, role, viewer, top)
    out = df.select(*[view.value(top[f.name], f.dataType, f.name, None).alias(f.name) for f in df.schema])
    if lost := set(view.masks) - view.met:
        raise ValueError(f"no such fields: {', '.join(sorted(lost))}")
    return out
