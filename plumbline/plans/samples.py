"""Source files made from the table ``part``: a COBOL program, a Perl package and a Fortran module
for each row, and a copybook for most brands. In the texts ``{k}`` is the part's key, ``{u}`` half
of it, ``{s}`` its size and ``{b}`` its brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.storage import dealt

from .registry import read

COBOL = """\
IDENTIFICATION DIVISION.
PROGRAM-ID. PROG{k}.
DATA DIVISION.
WORKING-STORAGE SECTION.
01 REC-{k}. 05 NAME-{k} PIC X({s}).
    05 PRICE-{k}
        PIC S9({s})V99 COMP-3.
    05 TAGS-{k} PIC 9(2) OCCURS {s} TIMES.
01 NOTE-{k} PIC X(9) VALUE 'A. 05 B'.
    88 SET-{k} VALUE 'Y'.
    COPY {b} REPLACING LEADING
        ==PRE== BY ==P{k}==.
PROCEDURE DIVISION.
MAIN-{k}. DISPLAY 'X. PERFORM Y'.
    OPEN INPUT IN-{k} AUX-{k}
         OUTPUT OUT-{k}.
    PERFORM STEP-{k} UNTIL SET-{k}.
    EVALUATE TRUE
      WHEN SET-{k} GO TO LAST-{k}
      WHEN OTHER CALL 'PROG{u}' USING REC-{k}
    END-EVALUATE.
    EXEC SQL
      INSERT INTO T VALUES (:NAME-{k})
    END-EXEC.
STEP-{k}. READ IN-{k} AT END MOVE 'Y' TO NOTE-{k}.
LAST-{k}.
    CLOSE IN-{k} AUX-{k} OUT-{k}. STOP RUN."""
BOOK = "       01 PRE-BOOK.\n          05 PRE-SIZE PIC 9(4)."
PERL = """\
package Lib::P{k};
use Moose;
use Lib::P{u} qw(load);

=pod

sub hidden { nothing(); }

=cut

has 'size' => (is => 'rw');

sub total
{
    my ($self, $rate) = @_;
    my $text = '}';   # } close(
    my $doc = <<"END_OF" . tail({s});
 } lost( {
END_OF
    return helper($rate / 2, $self->size()) if $text =~ m/}\\/{ x(/;
}
sub one { first({k}); }
sub keep {
    my $self = shift;
    open(my $fh, '>', 'p{k}.txt');
    my $check = sub { return valid($self); };
    close($fh);
}
final();
1;
"""
FORTRAN = """\
module m{k}
{use}
  implicit none
  real :: base{k} = 0.5   ! a comment; call none()
  type :: pt{k}
    integer :: x, y({s})
  end type pt{k}
contains
  function area{k}(p, q) result(r)
    type(pt{k}), intent(in) :: p
    real, dimension({s}) :: q
    real :: r
    call log_it('a; call no()'); call keep{u}(p)
    print *, 'x ! y'
  end function area{k}
end module m{k}
"""
#: By the key modulo 3: all names, two names of which one under another, all with one renamed.
USES = ["  use m{u}", "  use m{u}, only: near{k} => base{u}, pt{u}", "  use m{u}, away{k} => base{u}"]


def _filled(text: str, **values: Column) -> Column:
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def files(spark, d, language: str) -> DataFrame:
    """(path, content): a file for each part."""
    k, s, b = F.col("p_partkey"), F.col("p_size"), F.replace("p_brand", F.lit("#"), F.lit("-"))
    values = {"k": k, "u": F.floor(k / 2), "s": s, "b": b}
    part = dealt(read(spark, d, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey")
    if language == "cobol":
        number = lambda x, i: F.concat(F.rpad(F.concat(F.lpad((i * 10).cast("string"), 6, "0"), F.lit(" "), x), 72, " "), F.lpad(i.cast("string"), 8, "0"))
        content = F.array_join(F.transform(F.split(_filled(COBOL, **values), "\n"), number), "\n")
        return part.select(F.concat(F.lit("src/p"), k, F.lit(".cbl")).alias("path"), content.alias("content"))
    if language == "perl":
        return part.select(F.concat(F.lit("lib/P"), k, F.lit(".pm")).alias("path"), _filled(PERL, **values).alias("content"))
    use = F.when(k == 0, "").when(k % 3 == 0, USES[0]).when(k % 3 == 1, USES[1]).otherwise(USES[2])
    return part.select(F.concat(F.lit("src/m"), k, F.lit(".f90")).alias("path"), _filled(FORTRAN, use=use, **values).alias("content"))


def books(spark, d) -> DataFrame:
    """(path, content): the copybooks of brands whose number is no multiple of 3."""
    brands = read(spark, d, "part").select("p_brand").distinct()
    there = brands.filter(F.split("p_brand", "#")[1].cast("int") % 3 != 0)
    return there.select(F.concat(F.lit("src/copy/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".cpy")).alias("path"), F.lit(BOOK).alias("content"))
