"""Lexicons and pattern tables; parameters of the operators, with these as defaults."""

from __future__ import annotations

# Polarity, topics, lemmas and implicit errors of the entailment classifier.
POSITIVE = ("wraps around", "two's complement", "is safe", "is defined", "is valid", "is allowed", "is harmless", "well-defined", "guaranteed", "returns", "works", "succeeds")
NEGATIVE = (
    "undefined behavior", "undefined", "error", "invalid", "must not", "shall not", "constraint violation", "requires: NOT", "requires:", "Operation requires:",
    "must be", "shall be", "violat",
)
TOPICS = {
    "overflow": (r"\boverflow\b", r"\boverflows\b", r"\bexceed\b", r"\bexceeds\b", r"\bout of range\b"),
    "null_pointer": (r"\bnull pointer\b", r"\bnull\b", r"\bnullptr\b", r"\bNULL\b"),
    "division": (r"\bdivision by zero\b", r"\bdivide by zero\b", r"\bdivisor.{0,10}zero\b"),
    "buffer": (r"\bbuffer\b", r"\barray bounds\b", r"\bout.of.bounds\b", r"\bbounds\b"),
    "memory": (r"\bmemory\b", r"\balloc\b", r"\bfree\b", r"\bheap\b"),
    "pointer": (r"\bpointer\b", r"\bderef\b", r"\bdereference\b", r"\bdereferencing\b"),
    "integer": (r"\binteger\b", r"\bsigned\b", r"\bunsigned\b", r"\bint\b"),
}
LEMMAS = {
    "dereferencing": "dereference", "overflows": "overflow", "overflowing": "overflow",
    "dividing": "division", "allocating": "allocation", "allocates": "allocation",
}
IMPLICIT_ERRORS = (
    "signed integer overflow", "null pointer", "division by zero", "buffer overflow", "uninitialized",
    "out of bounds", "dangling pointer", "use after free", "double free", "integer division",
)
ERROR_MODULE_MARKS = ("ERROR", "VIOLATION", "UB", "UNDEFINED")

# The contradiction detector.
CONTRADICTION_PAIRS = (
    ("is safe", "undefined behavior", "direct"), ("is defined", "undefined", "direct"), ("is valid", "invalid", "direct"), ("can overflow", "must not overflow", "direct"),
    ("no check", "must check", "implied"), ("always", "not always", "semantic"), ("never", "may", "semantic"), ("guaranteed", "undefined", "direct"),
)
DANGEROUS_CLAIMS = (
    "signed integer overflow is defined", "null pointer dereference is safe", "buffer overflow is harmless", "uninitialized variables have default values",
    "casting pointer to integer is always safe", "division by zero returns zero", "array bounds are not checked",
)
SAFETY = ("is safe", "is defined", "is valid", "is allowed", "is harmless")
DANGER = ("undefined", "unsafe", "invalid", "not allowed", "dangerous")
SEARCH_EXPANSIONS = (
    (("overflow",), "overflow undefined behavior"), (("pointer",), "null pointer undefined"), (("division", "divide"), "division by zero undefined"),
    (("array", "buffer"), "array bounds undefined"), (("uninitialized",), "uninitialized undefined behavior"),
)
SENSITIVE = ("overflow", "buffer", "pointer", "null", "bounds")
NEGATIONS = (("is safe", "is unsafe"), ("is safe", "undefined behavior"), ("defined", "undefined"), ("valid", "invalid"), ("can", "cannot"), ("will", "will not"))

# What the search for candidate foundations adds to a function's content, and the concepts it looks for.
CANDIDATE_TERMS = "C++ lambda template parameter reference capture"
CANDIDATE_CONCEPTS = (
    (("lambda",), "lambda expression capture closure"), (("template", "parameter"), "template parameter instantiation"),
    (("reference", "capture"), "reference capture lifetime"), (("range", "iterator", "loop"), "range-based for loop iterator"),
)

# Predicates and terms that link rules to error codes.
PREDICATES = ("isPromoted", "isZero", "isUnknown", "==Type", "=/=Type", "isPointer", "isInteger", "hasIntegerType", "isFloat", "isComplete", "isConst")
ERROR_TERMS = {
    "division": ("division", "divide", "/"), "modulus": ("modulus", "modulo", "%", "remainder"), "overflow": ("overflow",), "zero": ("zero", "0"), "pointer": ("pointer",),
    "integer": ("integer", "int"), "float": ("float", "floating"), "type": ("type",), "conversion": ("conversion", "convert"), "shift": ("shift", "<<", ">>"),
}
SPEC_TERMS = {"zero": ("zero", "iszero"), "pointer": ("pointer",), "integer": ("integer", "int"), "float": ("float",), "type": ("type",)}
SPEC_TAGS = (
    (("isPromoted",), "type_promotion"), (("isZero",), "zero_check"), (("==Type", "=/=Type"), "type_compatibility"), (("isPointer",), "pointer"),
    (("isInteger",), "integer"), (("isFloat",), "float"),
)
CODE_PREFIXES = ("UB", "CV", "USP", "IMPL", "SE", "L", "IMPLUB")

# Names that open and close something.
NAMING = (
    (r"^(.+)_begin$", "$1_end"), (r"^(.+)_start$", "$1_stop"), (r"^(.+)_open$", "$1_close"), (r"^(.+)_lock$", "$1_unlock"), (r"^(.+)_init$", "$1_destroy"), (r"^(.+)_init$", "$1_cleanup"),
    (r"^(.+)_init$", "$1_free"), (r"^(.+)_init$", "$1_finish"), (r"^(.+)_acquire$", "$1_release"), (r"^create_(.+)$", "destroy_$1"), (r"^alloc_(.+)$", "free_$1"), (r"^new_(.+)$", "delete_$1"),
)
STATIC_PAIRS = (
    ("std::any::any", "std::any::~any"), ("std::variant::variant", "std::variant::~variant"), ("std::shared_ptr::shared_ptr", "std::shared_ptr::~shared_ptr"),
    ("std::weak_ptr::weak_ptr", "std::weak_ptr::~weak_ptr"), ("std::condition_variable", "std::condition_variable::~condition_variable"),
    ("std::condition_variable_any", "std::condition_variable_any::~condition_variable_any"), ("std::weak_ptr::lock", "std::weak_ptr::reset"),
    ("push_back", "pop_back"), ("push_front", "pop_front"), ("emplace_back", "pop_back"), ("emplace_front", "pop_front"),
    ("ranges::begin", "ranges::end"), ("ranges::rbegin", "ranges::rend"), ("ranges::cbegin", "ranges::cend"), ("ranges::crbegin", "ranges::crend"),
    ("std::make_shared", "std::shared_ptr::~shared_ptr"), ("std::allocate_shared", "std::shared_ptr::~shared_ptr"),
)
PROVIDER_WORDS = ("provides", "defines", "creates", "introduces", "declares", "establishes")
REQUIRER_WORDS = ("requires", "must be", "must have", "needs", "access to")
QUERY_TEMPLATES = ("%s", "%s provides", "%s parameter", "provides %s", "macro %s")
KEYWORD_PATTERNS = (
    r"requires?\s+(\w+)\s+(?:to be|in scope|variable|must)", r"(\w+)\s+must\s+(?:be|have|exist)", r"must\s+(?:be\s+)?(?:used\s+)?(?:within|inside)\s+(\w+)", r"access\s+to\s+(\w+)",
    r"(\w+)\s+(?:variable|parameter)\s+(?:must|in scope)", r"(\w+)\s+must\s+be\s+a\s+(?:valid\s+)?(?:\w+)", r"\w+\s+must\s+be\s+a\s+(?:valid\s+)?(\w+)", r"requires?\s+(\w+)\s+macro", r"provided\s+by\s+(\w+)",
)

# Operation families.
DIVISIONS = ("division", "modulo")
POINTER_OPS = ("pointer_deref", "array_access", "arrow_access")
MEMORY_OPS = ("allocation", "deallocation", "new", "delete")
CALLS = ("function_call",)
MACRO_KEYWORDS = ("if", "while", "for", "switch", "sizeof", "typeof", "alignof")
NOT_FUNCTIONS = ("tv", "utype", "type", "lval", "reval", "K")

# What predicates of a condition say, and operations' names.
CONDITION_TEMPLATES = {
    "notBool isZero": "divisor must be non-zero", "isZero": "value must be zero", "isNullPointerConstant": "value is a null pointer constant",
    "notBool isNullPointerConstant": "value must not be null", "==K NullPointer": "is a null pointer", "=/=K NullPointer": "must not be a null pointer",
    "isPromoted": "operand must be integer-promoted", "notBool isPromoted": "operand requires integer promotion", "==Type": "operand types must match", "=/=Type": "operand types differ",
    "isCompleteType": "type must be complete", "notBool isCompleteType": "type is incomplete", "isCompletePointerType": "pointer must point to complete type",
    "isPointerType": "operand is a pointer type", "isPointerUType": "operand is a pointer type", "notBool isPointerUType": "operand must not be a pointer",
    "isFunctionPointerType": "operand is a function pointer", "notBool isFunctionPointerType": "operand must not be a function pointer",
    "isIntegerType": "operand is an integer type", "isIntegerUType": "operand is an integer type", "hasIntegerType": "operand has integer type",
    "isSignedIntegerType": "operand is a signed integer", "isUnsignedIntegerType": "operand is an unsigned integer",
    "isFloatType": "operand is a floating-point type", "isFloatUType": "operand is a floating-point type",
    "isVoidType": "type is void", "notBool isVoidType": "type must not be void", "isArithmeticType": "operand is an arithmetic type", "isScalarType": "operand is a scalar type",
    "isBoolType": "operand is a boolean type", "isCharType": "operand is a character type", "isWCharType": "operand is a wide character type",
    "isStructOrUnionType": "operand is a struct or union", "notBool isStructOrUnionType": "operand must not be a struct or union", "isArrayType": "operand is an array type",
    "isBasicType": "operand is a basic type", "isBitfieldType": "operand is a bitfield type",
    "notBool isConstType": "operand must not be const-qualified", "isConstType": "operand is const-qualified", "isVolatileType": "operand is volatile-qualified",
    "isUnknown": "value is indeterminate", "notBool isUnknown": "value must be determinate", "hasUnknown": "contains indeterminate value", "notBool hasUnknown": "must not contain indeterminate values",
    "isTrap": "value is a trap representation", "notBool isTrap": "value must not be a trap representation", "hasTrap": "contains trap representation",
    "notBool hasTrap": "must not contain trap representations", "isOpaque": "value is opaque", "notBool isOpaque": "value must not be opaque",
    ">Int max(T)": "value exceeds maximum for type (overflow)", "<Int min(T)": "value below minimum for type (underflow)",
    "<=Int max(T)": "value must not exceed type maximum", ">=Int min(T)": "value must not be below type minimum",
    "fromConstantExpr": "must be a constant expression", "notBool fromConstantExpr": "is not a constant expression", "isHold": "expression is held for evaluation",
    "notBool isHold": "expression is not held", "isSymLoc": "value is a symbolic location", "notBool isSymLoc": "value must not be a symbolic location",
    "isLocation": "value is a memory location", "notBool isLocation": "value is not a memory location",
    "isKResult": "is a K result", "notBool isKResult": "is not yet a K result", "isRHold": "is a held rvalue", "notBool isRHold": "is not a held rvalue",
    "isLValue": "must be an lvalue", "isModifiableLValue": "must be a modifiable lvalue", "isNPC": "is a null pointer constant",
    "hasFloat": "contains floating-point value", "notBool hasFloat": "must not contain floating-point", "hasInt": "contains integer value", "notBool hasInt": "must not contain integer",
}
OPERATION_NAMES = {
    "division": "Integer division", "modulus": "Modulus operation", "multiplication": "Integer multiplication", "addition": "Addition", "subtraction": "Subtraction", "shift": "Bit shift",
    "bitwise": "Bitwise operation", "comparison": "Comparison", "assignment": "Assignment", "cast": "Type conversion", "conversion": "Type conversion", "dereference": "Pointer dereference",
    "subscript": "Array subscript", "member": "Member access", "call": "Function call", "operation": "Operation",
}
READABLE_SIGNS = (("=/=K", "≠"), ("==K", "="), ("=/=Type", "types differ"), ("==Type", "types match"), ("<=Int", "≤"), (">=Int", "≥"), (">Int", ">"), ("<Int", "<"), ("<=Quals", "qualifiers ⊆"))

# Exceptions, type names of signatures, and language concepts with the query that finds their rules.
EXCEPTIONS = (
    "bad_optional_access", "bad_variant_access", "bad_any_cast", "bad_alloc", "out_of_range", "length_error", "invalid_argument", "overflow_error", "underflow_error",
    "domain_error", "range_error", "runtime_error", "logic_error", "system_error",
)
SIGNATURE_TYPES = {
    r"\b(\w+)&": "reference", r"const\s+(\w+)&": "const_reference", r"\b(\w+)\*": "pointer", r"const\s+(\w+)\*": "const_pointer", r"\bsize_type\b": "size_type",
    r"\bsize_t\b": "size_t", r"\ballocator_type\b": "allocator_type", r"\ballocator\b": "allocator", r"\biterator\b": "iterator", r"\bInputIterator\b": "InputIterator",
    r"\bForwardIterator\b": "ForwardIterator", r"\bBidirectionalIterator\b": "BidirectionalIterator", r"\bRandomAccessIterator\b": "RandomAccessIterator",
    r"\bconst_iterator\b": "const_iterator", r"\breference\b": "reference", r"\bconst_reference\b": "const_reference", r"\bvalue_type\b": "value_type",
    r"\bkey_type\b": "key_type", r"\bmapped_type\b": "mapped_type", r"std::optional<": "optional", r"std::variant<": "variant", r"std::any\b": "any",
    r"std::expected<": "expected", r"std::shared_ptr<": "shared_ptr", r"std::unique_ptr<": "unique_ptr", r"std::weak_ptr<": "weak_ptr",
}
CONCEPTS = {
    r"\blifetime\b": "object lifetime", r"\bstorage\s+duration\b": "storage duration", r"\bdestruct": "destructor", r"\bconstruct": "constructor", r"\blvalue\b": "lvalue",
    r"\brvalue\b": "rvalue", r"\bxvalue\b": "xvalue", r"\bprvalue\b": "prvalue", r"\bglvalue\b": "glvalue", r"\bstatic\s+storage\b": "static storage duration",
    r"\bthread\s+local\b": "thread storage duration", r"\bautomatic\s+storage\b": "automatic storage duration", r"\bdynamic\s+storage\b": "dynamic storage duration",
    r"\bblock\s+scope\b": "block scope automatic", r"\binitializ": "initialization", r"\bdefault[- ]initializ": "default initialization",
    r"\bvalue[- ]initializ": "value initialization", r"\bdirect[- ]initializ": "direct initialization", r"\bcopy[- ]initializ": "copy initialization",
    r"\blist[- ]initializ": "list initialization", r"\baggregate[- ]initializ": "aggregate initialization", r"\breference\s+initializ": "reference initialization",
    r"\bzero[- ]initializ": "zero initialization", r"\breference\b": "reference", r"\bforwarding\s+reference\b": "forwarding reference",
    r"\buniversal\s+reference\b": "forwarding reference", r"\brvalue\s+reference\b": "rvalue reference", r"\blvalue\s+reference\b": "lvalue reference",
    r"\bdangling\s+reference\b": "reference lifetime", r"\blambda\b": "lambda expression", r"\bcapture\b": "lambda capture", r"\bclosure\b": "lambda closure",
    r"\bco_await\b": "await expression", r"\bcoroutine\b": "coroutine await", r"\bcast\b": "cast expression", r"\bstatic_cast\b": "static cast",
    r"\bdynamic_cast\b": "dynamic cast", r"\breinterpret_cast\b": "reinterpret cast", r"\bconst_cast\b": "const cast", r"\bsizeof\b": "sizeof expression",
    r"\balignof\b": "alignof expression", r"\bnew\s+expression\b": "new expression", r"\bdelete\s+expression\b": "delete expression",
    r"\boperator\s+new\b": "new expression", r"\boperator\s+delete\b": "delete expression", r"\boperator\b": "operator", r"\bconversion\b": "conversion",
    r"\bimplicit\s+conversion\b": "implicit conversion", r"\bexplicit\s+conversion\b": "explicit conversion", r"\bnarrowing\s+conversion\b": "narrowing conversion",
    r"\boverload\b": "overload resolution", r"\boverload\s+resolution\b": "overload resolution match", r"\bcandidate\s+function\b": "overload candidate",
    r"\bviable\s+function\b": "overload viable", r"\bbest\s+viable\b": "overload match best", r"\bambiguous\b": "overload ambiguous", r"\btemplate\b": "template",
    r"\btemplate\s+parameter\b": "template parameter", r"\btemplate\s+argument\b": "template argument", r"\btemplate\s+instantiation\b": "template instantiation",
    r"\bexplicit\s+specialization\b": "template explicit specialization", r"\bpartial\s+specialization\b": "template partial specialization",
    r"\bSFINAE\b": "template substitution failure", r"\bsubstitution\s+failure\b": "template substitution failure", r"\btype\s+deduction\b": "template type deduction",
    r"\bauto\b": "auto type deduction", r"\bdecltype\b": "decltype", r"\bconcept\b": "concept", r"\bconstraint\b": "concept constraint",
    r"\brequires\s+clause\b": "requires clause", r"\brequires\s+expression\b": "requires expression", r"\bsatisf": "concept satisfies", r"\bsame_as\b": "same_as concept",
    r"\bexception\b": "exception", r"\bthrow\b": "throw expression", r"\bcatch\b": "exception catch", r"\btry\b": "exception try", r"\bnoexcept\b": "noexcept",
    r"\bstack\s+unwinding\b": "exception stack unwinding", r"\bexception\s+specification\b": "exception specification", r"\bcopy\s+constructor\b": "copy constructor",
    r"\bmove\s+constructor\b": "move constructor", r"\bcopy\s+assignment\b": "copy assignment", r"\bmove\s+assignment\b": "move assignment",
    r"\bdefault\s+constructor\b": "default constructor", r"\bdestructor\b": "destructor", r"\bimplicitly[- ]declared\b": "implicit special member",
    r"\bdefaulted\b": "defaulted special member", r"\bdeleted\b": "deleted special member", r"\btrivial\b": "trivial special member", r"\bclass\b": "class",
    r"\bstruct\b": "class struct", r"\bbase\s+class\b": "base class", r"\bderived\s+class\b": "derived class", r"\binheritance\b": "inheritance", r"\bvirtual\b": "virtual",
    r"\bpure\s+virtual\b": "pure virtual", r"\babstract\s+class\b": "abstract class", r"\baccess\s+specifier\b": "access specifier", r"\bpublic\b": "public access",
    r"\bprotected\b": "protected access", r"\bprivate\b": "private access", r"\batomic\b": "atomic", r"\bmemory\s+order\b": "memory order",
    r"\bsequentially[- ]consistent\b": "sequentially consistent", r"\bacquire\b": "acquire", r"\brelease\b": "release", r"\bfence\b": "fence",
    r"\bdata\s+race\b": "data race", r"\bhappens[- ]before\b": "happens before", r"\bsynchroniz": "synchronization", r"\bthread\b": "thread",
    r"\bforward\s+progress\b": "forward progress", r"\bblocking\b": "blocking", r"\bdeadlock\b": "deadlock", r"\biterator\b": "iterator",
    r"\binput\s+iterator\b": "input iterator", r"\boutput\s+iterator\b": "output iterator", r"\bforward\s+iterator\b": "forward iterator",
    r"\bbidirectional\s+iterator\b": "bidirectional iterator", r"\brandom\s+access\s+iterator\b": "random access iterator",
    r"\bcontiguous\s+iterator\b": "contiguous iterator", r"\bbegin\b": "begin iterator", r"\bend\b": "end iterator", r"\brange\b": "range",
    r"\brange[- ]based\s+for\b": "range-based for", r"\bview\b": "range view", r"\bfor\s+loop\b": "for statement", r"\bwhile\s+loop\b": "while statement",
    r"\bif\s+statement\b": "if statement", r"\bswitch\s+statement\b": "switch statement", r"\breturn\s+statement\b": "return statement", r"\bintegral\b": "integral type",
    r"\bfloating[- ]point\b": "floating point type", r"\bvoid\b": "void type", r"\bbool\b": "bool type", r"\bpointer\b": "pointer", r"\bnullptr\b": "nullptr",
    r"\barray\b": "array", r"\bfunction\s+pointer\b": "function pointer", r"\bmember\s+pointer\b": "member pointer",
}

# Names in rewrite rules that are no functions, and headers of library modules.
PRIMITIVES = (
    "tv", "utype", "type", "ut", "t", "lnew", "loc", "base", "bnew", "obj", "list", "Map", "Set", "List", "ListItem", "SetItem", "reval", "lval", "voidVal", "piece",
    "uninit", "makeArray", "fillArray", "Computation", "Call", "addProv", "fromArray", "size", "max", "min", "stripStorageSpecifiers", "dynamicType", "pointerType",
    "arrayType", "lengthString", "isNull", "isNativeLoc", "NullPointer",
)
MODULE_HEADERS = {
    "LIBC-STDLIB": "stdlib.h", "LIBC-STDLIB-SYNTAX": "stdlib.h", "LIBC-STRING": "string.h", "LIBC-STRING-SYNTAX": "string.h", "LIBC-STDIO": "stdio.h",
    "LIBC-STDIO-SYNTAX": "stdio.h", "LIBC-MATH": "math.h", "LIBC-MATH-SYNTAX": "math.h", "LIBC-CTYPE": "ctype.h", "LIBC-CTYPE-SYNTAX": "ctype.h", "LIBC-STDARG": "stdarg.h",
    "LIBC-STDARG-SYNTAX": "stdarg.h", "LIBC-TIME": "time.h", "LIBC-TIME-SYNTAX": "time.h", "LIBC-LOCALE": "locale.h", "LIBC-LOCALE-SYNTAX": "locale.h",
    "LIBC-SIGNAL": "signal.h", "LIBC-SIGNAL-SYNTAX": "signal.h", "LIBC-SETJMP": "setjmp.h", "LIBC-SETJMP-SYNTAX": "setjmp.h", "LIBC-ASSERT": "assert.h",
    "LIBC-ASSERT-SYNTAX": "assert.h", "LIBC-ERRNO": "errno.h", "LIBC-ERRNO-SYNTAX": "errno.h",
}
