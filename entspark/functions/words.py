"""Names that never refer to an entity."""

KEYWORDS = frozenset(
    """
    Arc Box Err False HashMap HashSet NULL None Ok Option Rc Result Self Some String True Vec abstract and append as
    assert async attr_accessor attr_reader attr_writer auto await begin bool boolean break byte cap case catch cerr chan
    char cin class const constexpr continue cout crate decimal def default defer define defined del delegate delete do
    double dyn dynamic elif else elsif end endif endl ensure enum event except explicit export extends extern f32 f64
    false final finally float fn for free friend from func function get global go i16 i32 i64 i8 if ifdef ifndef impl
    implements import in include init inline instanceof int interface internal is isize lambda len let loop make malloc
    map match mod module move mut namespace new nil nint noexcept nonlocal not nuint null nullptr number object of
    operator or out override package params partial pass pragma printf private protected pub public puts raise range
    readonly record ref register require rescue return sbyte scanf sealed select self set sizeof static str string
    struct super switch template then this throw trait true try type typedef typename typeof u16 u32 u64 u8 uint ulong
    undefined unless unsafe until use ushort usize using value var virtual void volatile when where while with yield
    """.split()
)

#: Almost always a local variable.
COMMON_NAMES = frozenset(
    """
    args base begin body callback code config content context count curr current data done entry error errors event file
    flag found handler head height index info input item items kind left length line list message meta mode name next
    node options opts output params path prev props query request response result results right root size source start
    state status stop tail target temp text value values width
    """.split()
)
