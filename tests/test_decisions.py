"""Decisions by function in four languages, with keywords inside strings and comments."""

import pytest

from quarrymeter.sources import decisions, tree

GO = r'''
package a
// if for func x() {
/* if { */
type T interface { Do(x int) (y interface{}) }
func (t *T) Do(x int) (y interface{}) {
	s := "if { \" for" + `raw if {
`
	if x > 1 && s != "" { return nil }
	for i := 0; i < 3; i++ { if i == 2 { continue } }
	for _, v := range list { go func() { if v { } }() }
	return '{'
}
func G[K any](k K) map[string]struct{} {
	switch v := k.(type) { case int: return nil; default: }
	switch { case true: }
	select { case <-c: }
	return map[string]struct{}{}
}
func straight() {}
'''
JAVA = r'''
package a; // if (
class A<T extends B> {
  /* while ( { */ String s = "if (x) { \" ";
  String t = """
    if (x) { "quoted" }
    """;
  A(int x) { if (x > 0) { this.x = x; } else { super.go(x); } }
  <R> List<? extends R> f(Map<String, ? super T> m, int... k) throws IOException, E {
    for (int i = 0; i < 3; i++) while (true) { break; }
    try { g(x -> x > 1 ? 2 : 3, () -> { if (a) {} }); } catch (E e) { } finally { }
    switch (k) { case 1 -> go(); default -> { if (b) {} } }
    new Thread() { public void run() { do { } while (c); } };
    return m;
  }
  abstract int none(int x);
  char c = '"';
}
'''
JS = r'''
// function no() { if (x) {} }
const re = /if \/ [/"] {/g, q = a / b / c;
function f(x) {
  const t = `if ${x ? `for ${y}` : "while {"} {`;
  if (x) { } else if (y) { } else { }
  for (const k of x) { while (k) { } }
  return x?.y ?? z;
}
class A {
  constructor(x) { switch (x) { case 1: break; default: } }
  async get(k) { try { await k; } catch { } finally { } }
  static m = (a, b) => a ? b : (c => { if (c) { } })(b);
}
const g = function* () { if (1) { } };
const o = { h() { do { } while (x); }, if: 1 };
list.map(x => x).filter(function (v) { return v && !v.if; });
'''
RUST = r'''
// fn no() { if x {} }
/* if { /* nested */ for { */
impl<'a> Tr for S<'a> {
    fn f(&self, x: &'a str) -> Result<u8, E> where Self: Sized {
        let c = '{'; let s = r#"if " {"#; let b = b"\" if {";
        if let Some(v) = x { v? } else { loop { break; } }
        match x { A | B if y => 1, C { z } => { while z {} 2 } _ => 3, };
        for i in 0..=3 { it.map(|k| if k { 1 } else { 2 }).all(|_| true); }
        let h = move || { if q { 1 } else { 2 } };
        Ok(g(x)?)
    }
    fn sig(&self);
}
fn straight() -> [u8; 2] { [1, 2] }
'''
CASES = {
    # do: if, two ifs, for with clauses, for; the literal: if
    ".go": (GO, [("Do", 2 + 3 + 2 + 2), ("func", 2), ("G", 2 + 1 + 1 + 1 + 1 + 1), ("straight", 0)]),
    ".java": (JAVA, [("A", 2), ("f", 2 + 2 + 2 + 2 + 1 + 2 + 1 + 2), ("lambda", 1), ("lambda", 2), ("run", 2)]),
    ".js": (JS, [("f", 1 + 2 + 1 + 2 + 1 + 2 + 2), ("constructor", 2 + 2 + 1), ("get", 2 + 2 + 1), ("arrow", 1), ("arrow", 2), ("h", 2), ("arrow", 0), ("function", 0)]),
    ".rs": (RUST, [("f", 2 + 1 + 1 + 2 + 3 + 3 * 2 + 2 + 2 + 2 + 1), ("closure", 3), ("closure", 0), ("closure", 3), ("straight", 0)]),
}


@pytest.mark.parametrize("ext", CASES)
def test_decisions(ext):
    text, expect = CASES[ext]
    got = decisions.decisions(text, decisions.LANGUAGES[ext])
    assert sorted(got) == sorted(expect), got


@pytest.mark.parametrize("ext", CASES)
def test_odd_sources(ext):
    lang = decisions.LANGUAGES[ext]
    assert decisions.decisions("", lang) == [] and decisions.decisions("{ ( }", lang) is None and decisions.decisions("f( {", lang) is None
    assert decisions.decisions("\x00 é \"open", lang) is not None
    assert decisions.decisions("// only\n" * 1000, lang) == []


def test_every_language_in_one_relation(spark):
    rows = [("r", f"a{e}", e, t, len(t)) for e, (t, _) in CASES.items()] + [("r", "b.go", ".go", "func (", 6), ("r", "c.go", ".go", GO, 2_000_000), ("r", "d.py", ".py", "def f():\n  if x: pass\n", 9), ("r", "e.kt", ".kt", "fun", 3), ("r", "n.js", ".js", None, None)]
    files = spark.createDataFrame(rows, "repo string, path string, ext string, text string, size long")
    got = tree.function_decisions(files).collect()
    assert {r.path for r in got if not r.parsed} == {"b.go", "c.go", "e.kt", "n.js"}
    assert {r.path: sum(x.decisions for x in got if x.path == r.path) for r in got if r.parsed} == {**{f"a{e}": sum(n for _, n in x) for e, (_, x) in CASES.items()}, "d.py": 1}
    decisions.register(spark)
    files.createOrReplaceTempView("sources")
    sql = spark.sql("SELECT path, function, decisions FROM sources, LATERAL source_decisions(ext, text) WHERE size < 1000000")
    assert sql.where("path = 'a.rs'").count() == 5 and sql.where("path = 'b.go'").count() == 0
