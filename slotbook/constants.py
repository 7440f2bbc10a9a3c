"""Fixed values of the booking domain.

Everything in this module must equal the source application's values for
results to match: enum domains, reason codes, validation messages, the
endpoint role table and validation patterns.  They are stated plainly, in the
order the application declares them.
"""

# --- fixed values: enums -------------------------------------------------------
ORDER_PENDING = "PENDING"
ORDER_COMPLETED = "COMPLETED"
ORDER_EXPIRED = "EXPIRED"
ORDER_STATUSES = (ORDER_PENDING, ORDER_COMPLETED, ORDER_EXPIRED)

BAN_APPROVAL_PENDING = "PENDING"
BAN_APPROVAL_BANNED = "BANNED"
BAN_APPROVAL_REVOKED = "REVOKED"

BAN_STATUS_PENDING = "PENDING"
BAN_STATUS_ACTIVE = "ACTIVE"
BAN_STATUS_BANNED = "BANNED"

GENDER_MALE = "MALE"
GENDER_FEMALE = "FEMALE"
GENDERS = (GENDER_MALE, GENDER_FEMALE)

ROLE_OWNER = "OWNER"
ROLE_ADMIN = "ADMIN"
ROLE_MEMBER = "MEMBER"

# --- fixed values: reason codes ---------------------------------------------
OK = "0000"
ERR_GENERAL = "1000"
# sign-up
SIGNUP_FIELDS = "1001"
SIGNUP_DUPLICATE = "1002"
# places
PLACE_CREATE_FIELDS = "1006"
PLACE_CREATE_DUPLICATE_ADMIN_NAMES = "1007"
PLACE_CREATE_EXISTS = "1009"
PLACE_LIST_BAD_CITY_IDS = "1010"
PLACE_UPDATE_FIELDS = "1011"
PLACE_DETAIL_NOT_FOUND = "1012"
PLACE_UPDATE_NOT_FOUND = "1013"
PLACE_UPDATE_MAX_CAPACITY = "1014"
PLACE_UPDATE_CONFLICT = "1015"
PLACE_ADMINS_FIELDS = "1016"
PLACE_ADMINS_INVALID_ENTRY = "1017"
# bookings
BOOKING_CREATE_FIELDS = "1019"
BOOKING_CREATE_PACKAGE_MISSING = "1020"
BOOKING_CREATE_PACKAGE_FULL = "1021"
BOOKING_CREATE_ONGOING_EXISTS = "1022"
BOOKING_DETAIL_BAD_ID = "1023"
BOOKING_DETAIL_NOT_FOUND = "1024"
# ban requests
BAN_REQUEST_FIELDS = "1025"
BAN_REQUEST_USER_MISSING = "1026"
BAN_REQUEST_EXISTS = "1027"
BAN_DECISION_FIELDS = "1028"
# bookings, status change
BOOKING_UPDATE_FIELDS = "1029"
BOOKING_UPDATE_BAD_ID = "1030"
BAN_DECISION_NOT_FOUND = "1031"
BAN_DECISION_PROCESSED = "1032"
BAN_REQUEST_BAD_ROLE = "1033"
BOOKING_UPDATE_NOT_MANAGED = "1034"
BOOKING_UPDATE_ALREADY_UPDATED = "1035"
# packages
PACKAGE_CREATE_FIELDS = "1036"
PACKAGE_CREATE_PLACE_MISSING = "1037"
PACKAGE_CREATE_NOT_ADMIN = "1038"
PACKAGE_CREATE_OVER_CAPACITY = "1039"
PACKAGE_CREATE_TYPE_MISSING = "1040"
PLACE_CREATE_CITY_MISSING = "1041"
PACKAGE_CREATE_BAD_PLACE_ID = "1042"
PLACE_DETAIL_BAD_ID = "1043"
PLACE_UPDATE_BAD_ID = "1044"
PLACE_ADMINS_BAD_ID = "1045"
# access gate
ACCESS_BANNED = "9998"
ACCESS_UNAUTHORIZED = "9999"

# --- fixed values: time rules -------------------------------------------------
BOOKING_TTL = "INTERVAL 2 HOURS"      # a PENDING booking lapses 2 h after creation
BAN_DURATION = "INTERVAL 3 DAYS"      # an approved ban is lifted 3 days later
ADMIN_EMAIL_DOMAIN = "gmail.com"      # e-mail domain given to generated admins

# --- fixed values: paging ------------------------------------------------------
DEFAULT_PAGE = 1
DEFAULT_LIMIT = 15

# --- fixed values: validation messages, per request field ---------------------
MSG_SIGNUP_GENDER = 'Field "gender" value must be either "MALE" or "FEMALE".'
MSG_SIGNUP_FULLNAME = 'Field "fullname" must be a valid alphabetical value.'
MSG_SIGNUP_USERNAME = 'Field "username" must be a valid alphanumeric value.'
MSG_SIGNUP_EMAIL = 'Field "email" must be a valid email address.'
MSG_SIGNUP_PASSWORD = 'Field "password" must be a strong password with minimum length of 8 chars.'
MSG_BAN_MEMBER_ID = 'Field "memberUserId" must be a valid uuid value.'
MSG_BAN_REASON = 'Field "banReason" must be a valid alphabetical value.'
MSG_BAN_REQUEST_ID = 'Field "banRequestId" must be a valid uuid value.'
MSG_BAN_DECISION = 'Field "banApprovalStatus" must be either "BANNED" or "REVOKED".'
MSG_PLACE_NAME = 'Field "name" must be a valid alphabetical value.'
MSG_PLACE_MAX_CAPACITY = 'Field "maxCapacity" must be a valid numeric (int) value.'
MSG_PLACE_ADDRESS = 'Field "address" must not be empty.'
MSG_PLACE_CITY_ID = 'Field "cityId" must be a valid uuid value.'
MSG_PLACE_ADMIN_NAMES = 'Field "adminNames" must be a valid array of string value, min 1 and max 10 element(s).'
MSG_PACKAGE_NAME = 'Field "name" must be a non-empty alphabet value.'
MSG_PACKAGE_CAPACITY = 'Field "capacity" must be valid integer value.'
MSG_PACKAGE_PRICE = 'Field "price" must be a valid integer value.'
MSG_PACKAGE_TYPE_ID = 'Field "massagePackageTypeId" must be a valid uuid value.'
MSG_PLACE_ADMINS = ('Field "admins" must be a valid array of object consisting of id '
                    '(mandatory if new admin), fullname, username, and isActive.')
MSG_BOOKING_PACKAGE_ID = 'Field "massagePackageId" must be a valid uuid value.'
MSG_BOOKING_STATUS = 'Field "orderStatus" value must be either "COMPLETED" or "EXPIRED"'

# --- fixed values: validation patterns (Java regex, also valid for DuckDB) ----
RE_ALPHA_SPACES = r"^[A-Za-z ]+$"
RE_ALPHANUMERIC = r"^[A-Za-z0-9]+$"
RE_NUMERIC = r"^[+-]?[0-9]+$"
RE_UUID_ANY = (r"^([0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[1-8][0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}"
               r"|0{8}-0{4}-0{4}-0{4}-0{12}|[Ff]{8}-[Ff]{4}-[Ff]{4}-[Ff]{4}-[Ff]{12})$")
RE_UUID_V4 = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-4[0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}$"
RE_EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
RE_LOWER = r"[a-z]"
RE_UPPER = r"[A-Z]"
RE_DIGIT = r"[0-9]"
RE_SYMBOL = r"[^A-Za-z0-9]"
STRONG_PASSWORD_MIN_LENGTH = 8
ARRAY_MIN_ITEMS = 1
ARRAY_MAX_ITEMS = 10

# --- fixed values: operation -> allowed roles (route table) -------------------
ENDPOINT_ROLES = [
    ("city.list", [ROLE_OWNER, ROLE_MEMBER]),
    ("booking.create", [ROLE_MEMBER]),
    ("booking.ongoing", [ROLE_ADMIN, ROLE_MEMBER]),
    ("booking.update_status", [ROLE_ADMIN]),
    ("booking.detail", [ROLE_ADMIN]),
    ("booking.log", [ROLE_ADMIN]),
    ("booking.profit", [ROLE_OWNER]),
    ("booking.member_counts", [ROLE_ADMIN]),
    ("place.create", [ROLE_OWNER]),
    ("place.create_package", [ROLE_ADMIN]),
    ("place.list", [ROLE_OWNER, ROLE_MEMBER]),
    ("place.detail", [ROLE_OWNER, ROLE_MEMBER]),
    ("place.update", [ROLE_OWNER]),
    ("place.update_admins", [ROLE_OWNER]),
    ("package_type.list", [ROLE_ADMIN]),
    ("user.request_ban", [ROLE_ADMIN]),
    ("user.decide_ban", [ROLE_OWNER]),
    ("user.list_ban_requests", [ROLE_OWNER]),
]
