"""Small sources for the parser queries."""

COBOL = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAYROLL.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
      * totals
       01 EMPLOYEE-RECORD.
          05 EMP-NAME PIC X(30).
          05 EMP-PAY.
             10 PAY-BASE PIC 9(7)V99.
             10 PAY-RATE PIC S9(3)V9(4).
          05 EMP-MONTHS PIC 9(8) OCCURS 12 TIMES.
       77 WS-EOF PIC X VALUE 'N'.
          88 DONE VALUE 'Y'.
       PROCEDURE DIVISION.
       MAIN-PARA.
           OPEN INPUT PAY-FILE.
           PERFORM READ-PAY UNTIL DONE.
           PERFORM FIRST-STEP THRU LAST-STEP.
           CALL 'TAXCALC' USING EMP-PAY.
           CLOSE PAY-FILE.
           GO TO FINISH.
       READ-PAY.
           READ PAY-FILE AT END MOVE 'Y' TO WS-EOF.
           DISPLAY EMP-NAME.
       FINISH.
           STOP RUN.
"""
PERL = """\
package Shop::Cart;
use Moose::Role;
use List::Util qw(sum);

=pod

Ignored text.

=cut

has 'items' => (is => 'rw');

sub total {
    my ($self, $rate) = @_;
    my @prices = map { $_->price() } @{ $self->items };
    if (@prices) { return sum(@prices) * $rate; }
    return 0;
}

sub save {
    my $self = shift;
    open(my $fh, '>', 'cart.txt');
    my $check = sub { return validate($self); };
    $dbh->do('INSERT INTO cart VALUES (1)');
    close($fh);
}
1;
"""
FORTRAN = """\
! solver
module linear
  use constants
contains
  subroutine solve(a, b, n)
    integer, intent(in) :: n
    real, dimension(n) :: a, b
    double precision :: total
    if (n > 0) then
      call pivot(a, n)
    end if
    write(*,*) total
  end subroutine solve
  real function norm(x)
    real :: x
    norm = abs(x)
  end function norm
end module linear
"""
CONSTANTS = """\
module CONSTANTS
  real, parameter :: pi = 3.14159, tiny = 1.0e-6
  integer limit
end module CONSTANTS
"""
FIXED = """\
C     an old routine
      SUBROUTINE SCALE(X, N,
     &                 FACTOR)
      INTEGER N
      REAL X(N), FACTOR
      CHARACTER*20 NAME
      ASSOCIATE (Y => X)
      END ASSOCIATE
      CALL CHECK(N)
      CLOSE(7)
      END
"""
COPYING = """\
       IDENTIFICATION DIVISION.
       PROGRAM-ID. BILLING.
       DATA DIVISION.
       WORKING-STORAGE SECTION.
      * COPY NOTHING.
           COPY RECORD REPLACING LEADING ==PRE== BY ==BILL==
               ==SIZE-N== BY ==12==.
           COPY DFHAID.
       PROCEDURE DIVISION.
       MAIN-PARA.
           EVALUATE TRUE
             WHEN BILL-OPEN GO TO FINISH
             WHEN OTHER CONTINUE
           END-EVALUATE.
           EXEC SQL
             INSERT INTO BILLS
             VALUES (:BILL-NAME)
           END-EXEC.
           EXEC CICS SEND MAP('BILL') END-EXEC.
       FINISH.
           STOP RUN.
"""
RECORD = """\
       01 PRE-RECORD.
          05 PRE-NAME PIC X(SIZE-N).
           COPY money.
"""
MONEY = """\
          05 PAID PIC 9(5)V99."""
FILES = {
    "copy": [("src/billing.cbl", COPYING), ("src/copybooks/record.cpy", RECORD), ("src/copybooks/MONEY.cpy", MONEY)],
    "cobol": [("src/payroll.cbl", COBOL)], "perl": [("lib/Cart.pm", PERL)], "fortran": [("src/linear.f90", FORTRAN), ("src/constants.f90", CONSTANTS), ("src/scale.f", FIXED)],
}
