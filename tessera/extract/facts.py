"""The facts of one file, and their Spark types."""

from __future__ import annotations

NAMES = "array<struct<name:string,alias:string>>"
SCHEMA = (
    "path string, language string, error string, "
    "definitions array<struct<pos:bigint,name:string,kind:string,start_line:bigint,end_line:bigint,bases:array<string>>>, "
    f"imports array<struct<pos:bigint,source:string,names:{NAMES},is_default:boolean,is_namespace:boolean,line:bigint>>, "
    "exports array<struct<pos:bigint,name:string,is_default:boolean,is_reexport:boolean,source:string,line:bigint>>, "
    "calls array<struct<pos:bigint,callee:string,line:bigint,containing_function:string,arguments:array<string>>>, "
    "assignments array<struct<pos:bigint,variable:string,callee:string,line:bigint,containing_function:string>>"
)
KINDS = ("definitions", "imports", "exports", "calls", "assignments")


class Facts:
    """Lists of rows by kind, in source order."""

    def __init__(self) -> None:
        self.rows: dict[str, list[dict]] = {k: [] for k in KINDS}

    def _add(self, of: str, **values) -> None:
        self.rows[of].append({"pos": len(self.rows[of]), **values})

    def definition(self, name: str, kind: str, start: int, end: int) -> None:
        self._add("definitions", name=name, kind=kind, start_line=start, end_line=end, bases=[])

    def bases(self, name: str, bases: list[str]) -> None:
        for row in self.rows["definitions"]:
            if row["name"] == name and row["kind"] == "Class":
                row["bases"] = bases

    def imported(self, source: str, names: list[tuple[str, str | None]], default: bool, namespace: bool, line: int) -> None:
        self._add("imports", source=source, names=[{"name": n, "alias": a} for n, a in names], is_default=default, is_namespace=namespace, line=line)

    def exported(self, name: str, default: bool, line: int, source: str | None = None) -> None:
        self._add("exports", name=name, is_default=default, is_reexport=source is not None, source=source, line=line)

    def call(self, callee: str, line: int, scope: str | None, arguments: list[str]) -> None:
        self._add("calls", callee=callee, line=line, containing_function=scope, arguments=arguments)

    def assignment(self, variable: str, callee: str, line: int, scope: str | None) -> None:
        self._add("assignments", variable=variable, callee=callee, line=line, containing_function=scope)
