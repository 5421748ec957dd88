"""The few expressions that Spark SQL and DuckDB write differently."""

from __future__ import annotations


class Spark:
    def joined(self, x: str, sep: str = ",", distinct: bool = False) -> str:
        return f"array_join(array_sort({'collect_set' if distinct else 'collect_list'}({x})), '{sep}')"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p}D)"

    def replaced(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def found(self, x: str, pattern: str) -> str:
        return f"{x} rlike r'{pattern}'"

    def all_found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', 0)"

    def first_found(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def matching(self, x: str, pattern: str) -> str:
        return f"filter({x}, w -> w rlike r'{pattern}')"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, '{sep}')"

    def item(self, x: str, i: int) -> str:
        return f"get({x}, {i})"

    def head(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    def text(self, x: str, sep: str) -> str:
        return f"array_join({x}, '{sep}')"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"

    def fixed(self, x: str) -> str:
        """Two decimals of a number from 0 to 100, its binary value rounded half to even: hundredths and
        their rest come from whole multiples of 2**-49 and what those leave out, all exact."""
        one, m = 1 << 49, f"cast(floor(({x}) * {1 << 49}D) as bigint)"
        q, above = f"(({m} * 100) div {one})", f"(({m} * 100) % {one} - {one // 2} + 100D * (({x}) * {one}D - {m}))"
        up = f"(case when {above} > 0 or ({above} = 0 and {q} % 2 = 1) then 1 else 0 end)"
        return f"concat(cast(({q} + {up}) div 100 as string), '.', lpad(cast(({q} + {up}) % 100 as string), 2, '0'))"

    def ordered(self, x: str, key: str, sep: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({key} as k, {x} as x))), s -> s.x), '{sep}')"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def product(self, a: str, b: str) -> str:
        return f"zip_with({a}, {b}, (x, y) -> cast(x as double) * y)"

    def rounded(self, x: str) -> str:
        """Millionths, as text."""
        return f"transform({x}, v -> cast(cast(round(v * 1000000) as bigint) as string))"

    def try_double(self, x: str) -> str:
        return f"try_cast({x} as double)"

    def unnested(self, relation: str, array: str, name: str) -> str:
        return f"{relation} lateral view explode({array}) t as {name}"


class Duck(Spark):
    def joined(self, x: str, sep: str = ",", distinct: bool = False) -> str:
        return f"array_to_string(list_sort(list({'distinct ' if distinct else ''}{x})), '{sep}')"

    def quantile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def replaced(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def found(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def all_found(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, '{pattern}')"

    def first_found(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def matching(self, x: str, pattern: str) -> str:
        return f"list_filter({x}, lambda w: regexp_matches(w, '{pattern}'))"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, '{sep.strip('[]')}')"

    def item(self, x: str, i: int) -> str:
        return f"({x})[{i + 1}]"

    def head(self, x: str, n: int) -> str:
        return f"({x})[1:{n}]"

    def text(self, x: str, sep: str) -> str:
        return f"array_to_string({x}, '{sep}')"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(list_transform({a}, lambda x: x::double), list_transform({b}, lambda x: x::double))"

    def fixed(self, x: str) -> str:
        return f"printf('%.2f', {x})"

    def ordered(self, x: str, key: str, sep: str) -> str:
        return f"string_agg({x}, '{sep}' order by {key}, {x})"

    def product(self, a: str, b: str) -> str:
        return f"list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double)"

    def rounded(self, x: str) -> str:
        return f"list_transform({x}, lambda v: round(v * 1000000)::bigint::varchar)"

    def json(self, x: str, key: str) -> str:
        return f"json_extract_string({x}, '$.{key}')"

    def unnested(self, relation: str, array: str, name: str) -> str:
        return f"{relation}, lateral (select unnest({array}) as {name}) t"
