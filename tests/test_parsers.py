"""Parsers on sources that line-by-line reading gets wrong, and on the samples' known records."""

import pytest
from plumbline.operators import parsers, statements
from plumbline.operators.perl_code import code_lines

from tests.parser_rows import EXPECTED
from tests.parser_samples import FILES


@pytest.mark.parametrize("language", ["cobol", "perl", "fortran"])
def test_samples(language):
    got = [(p, i, *r) for p, c in FILES[language] for i, r in enumerate(parsers.PARSERS[language](p, c))]
    assert sorted(got) == sorted(EXPECTED[f"{language}_ir"][1])


def numbered(*lines):
    return "\n".join(f"{i * 10:06d} {x}".ljust(72) + f"{i:08d}" for i, x in enumerate(lines))


def cobol(*lines, data=True):
    head = ["IDENTIFICATION DIVISION.", "PROGRAM-ID.", "    PROBE.", "DATA DIVISION.", "WORKING-STORAGE SECTION."]
    return [r for r in parsers.cobol("src/x.cbl", numbered(*head, *lines)) if r[0] != "module"]


def test_numbers_beside_the_text():
    got = cobol("PROCEDURE DIVISION.", "P1.", "    CALL 'A'.")
    assert got == [("function", "P1", "PROBE", "paragraph"), ("call", "A", "P1", "call")]


def test_statement_behind_a_paragraph_name():
    assert cobol("PROCEDURE DIVISION.", "P1. DISPLAY 'X. CALL Y'. GO TO P2.", "P2 SECTION. STOP RUN.") == [
        ("function", "P1", "PROBE", "paragraph"), ("io", "", "P1", "display:write"), ("call", "P2", "P1", "goto"), ("function", "P2", "PROBE", "section"),
    ]


def test_items_over_lines():
    got = cobol("01 A. 05 B PIC X(3). 05", "      C", "        PIC S9(4)V99", "      COMP-3.", "    05 PIC 9.", "77 M PIC X(9) VALUE 'A. 05 Z'.")
    assert [(r[1], r[2], r[3]) for r in got] == [("A", "", "struct(0,0)"), ("B", "A", "string(3,0)"), ("C", "A", "decimal(6,2)"), ("FILLER", "A", "integer(1,0)"), ("M", "", "string(9,0)")]


def test_open_of_several_files():
    got = cobol("PROCEDURE DIVISION.", "P.", "    OPEN INPUT F1 F2", "         OUTPUT F3 WITH NO REWIND I-O F4. CLOSE F1, F2 WITH LOCK.")
    assert [(r[1], r[3]) for r in got if r[0] == "io"] == [("F1", "open:read"), ("F2", "open:read"), ("F3", "open:write"), ("F4", "open:readwrite"), ("F1", "close:readwrite"), ("F2", "close:readwrite")]


def test_inline_and_computed():
    got = cobol("PROCEDURE DIVISION.", "P.", "    PERFORM 5 TIMES CALL 'A' END-PERFORM", "    PERFORM UNTIL X CALL B END-PERFORM", "    PERFORM Q N TIMES", "    PERFORM N TIMES DISPLAY X END-PERFORM", "    GO TO P1 P2 DEPENDING ON I.")
    assert [r[1] for r in got if r[0] == "call"] == ["A", "B", "Q", "P1", "P2"]


def test_continued_literals_and_words():
    lines = ["       PROCEDURE DIVISION.", "       P.", "           DISPLAY 'A. CALL", "      -    ' B. CALL C'.", "           CALL SUB", "      -    PROG.", "      * CALL NOBODY.", "           CALL 'Z'. *> CALL Y"]
    got = [r for r in parsers.cobol("x.cbl", "\n".join(lines)) if r[0] == "call"]
    assert [r[1] for r in got] == ["SUBPROG", "Z"]


def test_free_format():
    text = "identification division.\nprogram-id. free.\nprocedure division.\nmain.\n    display 'x *> y' *> call 'q'\n    if a = b\n        call 'z' else perform p end-if.\n"
    assert [r[:3] for r in parsers.cobol("a.cbl", text)][1:] == [("function", "main", "free"), ("io", "", "main"), ("call", "z", "main"), ("call", "p", "main")]


def test_statements_of_odd_texts():
    assert [statements.statements(t) for t in ("", "\n\n", ".", " . . ")] == [[], [], [], []]
    assert [s.text for s in statements.statements("A 1.5 B. 'x")] == ["A 1.5 B", "'x"]


PERL = r"""package A;
sub f1 { my $x = '}'; foo(); }
sub f2
{
    my ($a, $b) = @_;
    print "}{ not_call( ";   # bar( }
    if ($a =~ m/}\/{ x(/) { baz($b / 2, $a / 3); }
    my $t = <<"EOT" . tail();
 } lost( {
EOT
    s{a}{b(}g; tr/}/{/; my %h = (y => 1, s => 2, q => 3);
    my $n = $#{$a}; my $u = $h{y} / 2; other($h{s});
    return qux($a);
}
sub f3 { qux(); }
sub ahead;
sub f4 { return map { $_->go() } @_ } sub f5($p, $q) { h() }
my $y = q(a (b) } c);
last_one();

=head1 NAME

sub pod { lost() }

=cut

after();
__END__
sub no { lost() }
"""


def test_perl():
    got = list(parsers.perl("A.pm", PERL))
    assert [r[1] for r in got if r[0] == "function"] == ["f1", "f2", "f3", "f4", "f5"]
    assert [(r[1], r[2]) for r in got if r[0] == "call"] == [("foo", "f1"), ("baz", "f2"), ("tail", "f2"), ("other", "f2"), ("qux", "f2"), ("qux", "f3"), ("go", "f4"), ("h", "f5"), ("last_one", ""), ("after", "")]
    assert [(r[1], r[2]) for r in got if r[0] == "parameter"] == [("a", "f2"), ("b", "f2"), ("p", "f5"), ("q", "f5")]


def test_perl_literals_over_lines():
    code = code_lines("my $a = 'x\n } y';\nmy $b = {\n};\n$c = <<~A . <<'B';\n }\n  A\n {\nB\nd($x) if /}/ || $y / 2 / 3;")
    assert [x.bare.strip() for x in code] == ["my $a = ''", ";", "my $b = {", "};", "$c = '' . '';", "", "", "", "", "d($x) if '' || $y / 2 / 3;"]


FORTRAN = """module shapes
  use base, only: dp, zero => nil
  private
  public :: point, area
  type, extends(base_t), public :: point
    real(dp) :: x = 0.0, y(3)
    type(colour), pointer :: c
  contains
    procedure :: norm
  end type point
  character(len=20) :: s = 'a ! b; c'
contains
  real function area(p) result(a)
    class(point), intent(in) :: p
    a = 1; call log_it(p) ; print *, 'x; call no()'
  end function
end module
"""


def test_fortran():
    got = list(parsers.fortran("s.f90", FORTRAN))
    assert [r for r in got if r[0] in ("data_type", "field")] == [("data_type", "point", "shapes", "type"), ("field", "x", "point", "real scalar"), ("field", "y", "point", "real array"), ("field", "c", "point", "type(colour) scalar")]
    assert [r[1] for r in got if r[0] == "variable"] == ["s", "p"] and [r[1:] for r in got if r[0] == "call"] == [("log_it", "area", "call")]
    assert [r[1:] for r in got if r[0] == "import"] == [("dp", "shapes", "base:dp"), ("zero", "shapes", "base:nil")]


def test_scopes(spark):
    """Chains, renamings, privacy, names in any case, and modules that use each other."""
    sources = {
        "base": "module base\nuse ring\nreal :: nil, dp, hidden\nprivate :: hidden\nend module",
        "shapes": FORTRAN,
        "open": "module OPEN\nuse BASE, none => Nil\nreal :: own\nend module",
        "ring": "module ring\nuse open\nuse missing\nend module",
        "main": "program main\nuse open, only: null => none, own\nuse shapes\nend program",
    }
    files = spark.createDataFrame([(f"{k}.f90", v) for k, v in sources.items()], "path string, content string")
    got = {(r.unit, r.name, r.module, r.original) for r in parsers.scopes(parsers.parse(files, "fortran")).collect()}
    base = {("DP", "BASE", "DP"), ("NONE", "BASE", "NIL"), ("OWN", "OPEN", "OWN")}
    assert {g[1:] for g in got if g[0] == "MAIN"} == {("NULL", "BASE", "NIL"), ("OWN", "OPEN", "OWN"), ("POINT", "SHAPES", "POINT"), ("AREA", "SHAPES", "AREA")}
    assert {g[1:] for g in got if g[0] == "RING"} >= base and not {g for g in got if g[3] == "HIDDEN"}
    assert {g[1:] for g in got if g[0] == "SHAPES"} == {("DP", "BASE", "DP"), ("ZERO", "BASE", "NIL")}
    assert parsers.scopes(parsers.parse(files.limit(0), "fortran")).count() == 0
