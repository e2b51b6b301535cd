"""Symbols of Go, Rust and Java: comments that nest, raw strings, generics, impl blocks."""

from lodestone.sources.blocks import Blocks, blank

GO = '''package p
/* func No() { */
import "x"
type (
	Pair[K comparable, V any] struct {
		a K // }
		b V
	}
	alias = int
)
type Shape interface {
	Area() float64
}
var raw = `func Fake() {
}`
func (p *Pair[K, V]) First(f func(int) int) K {
	s := "}"
	r := '{'
	return pick(s, r)
}
func Map[T any](xs []T,
	f func(T) T,
) []T {
	for _, x := range xs { f(x) }
	return other.Do(xs)
}
func low() int { return 1 }
'''
RUST = '''/* outer /* fn inner() {} */ still a comment } */
pub struct Stack<T> where T: Clone {
    items: Vec<T>, // }
}
pub(crate) enum Kind { A, B }
struct Unit;
pub trait Show { fn show(&self) -> String; fn twice(&self) -> String { self.show() } }
impl<T: Clone> Stack<T> {
    pub fn push<'a>(&'a mut self, x: T) -> &'a T {
        let s = r#"fn fake() { "quoted" }"#;
        let c = '}';
        helper::<T>(x)
    }
    fn len(&self) -> usize { self.items.len() }
}
impl<T> fmt::Show for Stack<T> where T: Clone {
    fn show(&self) -> String { format(self) }
}
pub async unsafe fn top(x: [u8; 4]) -> u8 {
    fn nested() {}
    nested();
    x[0]
}
'''
JAVA = '''package p;
/** class Fake { */
@Entity(name = "x{")
public abstract class Box<T extends Comparable<T>> extends Base<T> implements One<T>, p.Two {
    private String text = """
        class NotMe {
        """;
    public Box(int n) { super(n); }
    @Override
    public <R> Map<String, List<R>> run(Function<T, R> f) throws IOException {
        String s = "}";
        char c = '{';
        Runnable r = () -> { go(c); };
        return this.make(new Thing<R>(s));
    }
    protected abstract void later(int x);
    int plain() { if (a()) { return b(); } return 0; }
    enum Level implements Ranked { LOW, HIGH; int rank() { return 1; } }
}
interface Quiet extends A, B { void hush(); }
'''


def told(language, text):
    b = Blocks(language, text)
    return sorted(b.symbols, key=lambda x: (x[3], x[0])), set(b.edges)


def test_go():
    symbols, edges = told("go", GO)
    assert symbols == [("Pair", "struct", True, 5, 8), ("alias", "type", False, 9, 9), ("Shape", "interface", True, 11, 13), ("Pair.First", "method", True, 16, 20), ("Map", "function", True, 21, 26), ("low", "function", False, 27, 27)]
    assert edges == {("Pair", "Pair.First", "HAS_METHOD"), ("Pair.First", "pick", "CALLS"), ("Map", "f", "CALLS"), ("Map", "Do", "CALLS")}


def test_rust():
    symbols, edges = told("rust", RUST)
    assert symbols == [
        ("Stack", "struct", True, 2, 4), ("Kind", "enum", True, 5, 5), ("Unit", "struct", False, 6, 6), ("Show", "trait", True, 7, 7), ("Stack.push", "method", True, 9, 13),
        ("Stack.len", "method", False, 14, 14), ("Stack.show", "method", False, 17, 17), ("top", "function", True, 19, 23), ("nested", "function", False, 20, 20),
    ]
    assert {e for e in edges if e[2] != "CALLS"} == {("Stack", "Show", "IMPLEMENTS"), ("Stack", "Stack.push", "HAS_METHOD"), ("Stack", "Stack.len", "HAS_METHOD"), ("Stack", "Stack.show", "HAS_METHOD")}
    assert {("Stack.push", "helper", "CALLS"), ("Stack.len", "len", "CALLS"), ("Stack.show", "format", "CALLS"), ("top", "nested", "CALLS")} == {e for e in edges if e[2] == "CALLS"}


def test_java():
    symbols, edges = told("java", JAVA)
    assert [(n, k, x, e) for n, k, x, _, e in symbols] == [
        ("Box", "class", True, 19), ("Box.run", "method", True, 15), ("Box.later", "method", False, 16), ("Box.plain", "method", False, 17), ("Level", "enum", False, 18), ("Level.rank", "method", False, 18), ("Quiet", "interface", False, 20), ("Quiet.hush", "method", False, 20),
    ]
    assert {e for e in edges if e[2] in ("EXTENDS", "IMPLEMENTS")} == {("Box", "Base", "EXTENDS"), ("Box", "One", "IMPLEMENTS"), ("Box", "Two", "IMPLEMENTS"), ("Level", "Ranked", "IMPLEMENTS"), ("Quiet", "A", "EXTENDS"), ("Quiet", "B", "EXTENDS")}
    assert {("Box.run", "go", "CALLS"), ("Box.run", "make", "CALLS"), ("Box.run", "Thing", "CALLS"), ("Box.plain", "a", "CALLS"), ("Box.plain", "b", "CALLS")} == {e for e in edges if e[2] == "CALLS"}


def test_blanks_keep_places():
    for language, text in (("go", GO), ("rust", RUST), ("java", JAVA)):
        plain = blank(language, text)
        assert [len(x) for x in plain.split("\n")] == [len(x) for x in text.split("\n")]
    assert blank("rust", "a /* b /* c */ d */ e").split() == ["a", "e"]
    assert blank("go", "a /* b /* c */ d").split() == ["a", "d"]
    assert blank("rust", "x: &'a str = \"'\"").split() == ["x:", "&'a", "str", "="]
    assert blank("java", "/* open").strip() == ""
