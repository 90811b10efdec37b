"""Rows that the queries over the samples must give: recorded from a run, then each read against
its line of the sample."""

EXPECTED = {
    'cobol_ir': (
        ['path', 'ord', 'record', 'name', 'parent', 'detail'],
        [
            ('src/payroll.cbl', 0, 'module', 'PAYROLL', '', 'cobol'),
            ('src/payroll.cbl', 1, 'data_type', 'EMPLOYEE-RECORD', '', 'struct(0,0)'),
            ('src/payroll.cbl', 2, 'data_type', 'EMP-NAME', 'EMPLOYEE-RECORD', 'string(30,0)'),
            ('src/payroll.cbl', 3, 'data_type', 'EMP-PAY', 'EMPLOYEE-RECORD', 'struct(0,0)'),
            ('src/payroll.cbl', 4, 'data_type', 'PAY-BASE', 'EMP-PAY', 'decimal(9,2)'),
            ('src/payroll.cbl', 5, 'data_type', 'PAY-RATE', 'EMP-PAY', 'decimal(7,4)'),
            ('src/payroll.cbl', 6, 'data_type', 'EMP-MONTHS', 'EMPLOYEE-RECORD', 'array<integer>x12(8,0)'),
            ('src/payroll.cbl', 7, 'data_type', 'WS-EOF', '', 'string(1,0)'),
            ('src/payroll.cbl', 8, 'data_type', 'DONE', 'WS-EOF', 'boolean(0,0)'),
            ('src/payroll.cbl', 9, 'function', 'MAIN-PARA', 'PAYROLL', 'paragraph'),
            ('src/payroll.cbl', 10, 'io', 'PAY-FILE', 'MAIN-PARA', 'open:read'),
            ('src/payroll.cbl', 11, 'call', 'READ-PAY', 'MAIN-PARA', 'perform'),
            ('src/payroll.cbl', 12, 'call', 'FIRST-STEP', 'MAIN-PARA', 'perform'),
            ('src/payroll.cbl', 13, 'call', 'TAXCALC', 'MAIN-PARA', 'call'),
            ('src/payroll.cbl', 14, 'io', 'PAY-FILE', 'MAIN-PARA', 'close:readwrite'),
            ('src/payroll.cbl', 15, 'call', 'FINISH', 'MAIN-PARA', 'goto'),
            ('src/payroll.cbl', 16, 'function', 'READ-PAY', 'PAYROLL', 'paragraph'),
            ('src/payroll.cbl', 17, 'io', 'PAY-FILE', 'READ-PAY', 'read:read'),
            ('src/payroll.cbl', 18, 'io', '', 'READ-PAY', 'display:write'),
            ('src/payroll.cbl', 19, 'function', 'FINISH', 'PAYROLL', 'paragraph'),
        ],
    ),
    'perl_ir': (
        ['path', 'ord', 'record', 'name', 'parent', 'detail'],
        [
            ('lib/Cart.pm', 0, 'module', 'Shop::Cart', '', 'perl'),
            ('lib/Cart.pm', 1, 'dependency', 'Moose::Role', 'Shop::Cart', 'oop'),
            ('lib/Cart.pm', 2, 'data_type', 'items', 'Shop::Cart', 'attribute'),
            ('lib/Cart.pm', 3, 'function', 'total', 'Shop::Cart', 'sub'),
            ('lib/Cart.pm', 4, 'parameter', 'self', 'total', 'unknown'),
            ('lib/Cart.pm', 5, 'parameter', 'rate', 'total', 'unknown'),
            ('lib/Cart.pm', 6, 'variable', 'prices', 'total', 'array'),
            ('lib/Cart.pm', 7, 'call', 'price', 'total', 'method'),
            ('lib/Cart.pm', 8, 'call', 'sum', 'total', 'function'),
            ('lib/Cart.pm', 9, 'function', 'save', 'Shop::Cart', 'sub'),
            ('lib/Cart.pm', 10, 'parameter', 'self', 'save', 'unknown'),
            ('lib/Cart.pm', 11, 'variable', 'self', 'save', 'string'),
            ('lib/Cart.pm', 12, 'variable', 'fh', 'save', 'string'),
            ('lib/Cart.pm', 13, 'io', '$fh', 'save', 'open:write'),
            ('lib/Cart.pm', 14, 'function', 'check', 'save', 'closure'),
            ('lib/Cart.pm', 15, 'variable', 'check', 'save', 'string'),
            ('lib/Cart.pm', 16, 'call', 'validate', 'save', 'function'),
            ('lib/Cart.pm', 17, 'call', 'do', 'save', 'method'),
            ('lib/Cart.pm', 18, 'io', 'do', 'save', 'dbi:readwrite'),
            ('lib/Cart.pm', 19, 'io', '$fh', 'save', 'close:readwrite'),
        ],
    ),
    'fortran_ir': (
        ['path', 'ord', 'record', 'name', 'parent', 'detail'],
        [
            ('src/constants.f90', 0, 'module', 'CONSTANTS', '', 'module'),
            ('src/constants.f90', 1, 'variable', 'pi', 'CONSTANTS', 'real scalar'),
            ('src/constants.f90', 2, 'variable', 'tiny', 'CONSTANTS', 'real scalar'),
            ('src/constants.f90', 3, 'variable', 'limit', 'CONSTANTS', 'integer scalar'),
            ('src/linear.f90', 0, 'module', 'linear', '', 'module'),
            ('src/linear.f90', 1, 'dependency', 'constants', 'linear', 'use'),
            ('src/linear.f90', 2, 'function', 'solve', 'linear', 'subroutine'),
            ('src/linear.f90', 3, 'parameter', 'a', 'solve', 'unknown'),
            ('src/linear.f90', 4, 'parameter', 'b', 'solve', 'unknown'),
            ('src/linear.f90', 5, 'parameter', 'n', 'solve', 'unknown'),
            ('src/linear.f90', 6, 'variable', 'n', 'solve', 'integer scalar in'),
            ('src/linear.f90', 7, 'variable', 'a', 'solve', 'real array'),
            ('src/linear.f90', 8, 'variable', 'b', 'solve', 'real array'),
            ('src/linear.f90', 9, 'variable', 'total', 'solve', 'double precision scalar'),
            ('src/linear.f90', 10, 'call', 'pivot', 'solve', 'call'),
            ('src/linear.f90', 11, 'io', 'write', 'solve', 'io'),
            ('src/linear.f90', 12, 'function', 'norm', 'linear', 'function'),
            ('src/linear.f90', 13, 'parameter', 'x', 'norm', 'unknown'),
            ('src/linear.f90', 14, 'variable', 'x', 'norm', 'real scalar'),
            ('src/scale.f', 0, 'function', 'SCALE', '', 'subroutine'),
            ('src/scale.f', 1, 'parameter', 'X', 'SCALE', 'unknown'),
            ('src/scale.f', 2, 'parameter', 'N', 'SCALE', 'unknown'),
            ('src/scale.f', 3, 'parameter', 'FACTOR', 'SCALE', 'unknown'),
            ('src/scale.f', 4, 'variable', 'N', 'SCALE', 'integer scalar'),
            ('src/scale.f', 5, 'variable', 'X', 'SCALE', 'real array'),
            ('src/scale.f', 6, 'variable', 'FACTOR', 'SCALE', 'real scalar'),
            ('src/scale.f', 7, 'variable', 'NAME', 'SCALE', 'character scalar'),
            ('src/scale.f', 8, 'call', 'CHECK', 'SCALE', 'call'),
            ('src/scale.f', 9, 'io', 'close', 'SCALE', 'io'),
        ],
    ),
    'cobol_expanded': (
        ['path', 'ord', 'record', 'name', 'parent', 'detail'],
        [
            ('src/billing.cbl', 0, 'module', 'BILLING', '', 'cobol'),
            ('src/billing.cbl', 1, 'data_type', 'BILL-RECORD', '', 'struct(0,0)'),
            ('src/billing.cbl', 2, 'data_type', 'BILL-NAME', 'BILL-RECORD', 'string(12,0)'),
            ('src/billing.cbl', 3, 'data_type', 'PAID', 'BILL-RECORD', 'decimal(7,2)'),
            ('src/billing.cbl', 4, 'function', 'MAIN-PARA', 'BILLING', 'paragraph'),
            ('src/billing.cbl', 5, 'call', 'FINISH', 'MAIN-PARA', 'goto'),
            ('src/billing.cbl', 6, 'io', 'INSERT', 'MAIN-PARA', 'sql:write'),
            ('src/billing.cbl', 7, 'io', 'SEND', 'MAIN-PARA', 'cics:write'),
            ('src/billing.cbl', 8, 'function', 'FINISH', 'BILLING', 'paragraph'),
        ],
    ),
    'copybook_warnings': (
        ['path', 'book', 'warning'],
        [
            ('src/billing.cbl', 'DFHAID', 'system copybook is not available'),
        ],
    ),
    'cobol_constructs': (
        ['path', 'function', 'exec_cics', 'exec_sql', 'evaluate', 'when', 'goto'],
        [
            ('src/billing.cbl', 'MAIN-PARA', 1, 1, 1, 1, 1),
        ],
    ),
    'fortran_imports': (
        ['path', 'unit', 'module', 'name'],
        [
            ('src/linear.f90', 'linear', 'CONSTANTS', 'limit'),
            ('src/linear.f90', 'linear', 'CONSTANTS', 'pi'),
            ('src/linear.f90', 'linear', 'CONSTANTS', 'tiny'),
        ],
    ),
    'fortran_parameters': (
        ['path', 'function', 'ord', 'name', 'type'],
        [
            ('src/linear.f90', 'norm', 13, 'x', 'real scalar'),
            ('src/linear.f90', 'solve', 3, 'a', 'real array'),
            ('src/linear.f90', 'solve', 4, 'b', 'real array'),
            ('src/linear.f90', 'solve', 5, 'n', 'integer scalar in'),
            ('src/scale.f', 'SCALE', 1, 'X', 'real array'),
            ('src/scale.f', 'SCALE', 2, 'N', 'integer scalar'),
            ('src/scale.f', 'SCALE', 3, 'FACTOR', 'real scalar'),
        ],
    ),
    'cobol_books': (
        ['path', 'book'],
        [
            ('src/billing.cbl', 'DFHAID.cpy'),
            ('src/billing.cbl', 'RECORD.cpy'),
        ],
    ),
    'source_metrics': (
        ['files', 'bytes', 'modules', 'functions', 'data_types', 'io', 'calls', 'language'],
        [
            (1, 465, 1, 3, 1, 3, 4, 'perl'),
            (1, 793, 1, 3, 8, 4, 4, 'cobol'),
            (3, 696, 2, 3, 0, 2, 2, 'fortran'),
        ],
    ),
}
