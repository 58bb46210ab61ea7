"""A Spark-first engine for cleaning tables: names, types and values."""

from importlib import import_module

#: Where each public name lives. They load on first use, which keeps workers light.
_PLACES = {
    "operators.base": ("BaseCleaner",),
    "operators.country": ("CountryCleaner",),
    "operators.custom": ("PythonCleaner",),
    "operators.extra": ("AddressLineCleaner", "BusinessCleaner", "CreditCardCleaner", "CurrencyCleaner", "GstinCleaner", "LanguageCodeCleaner", "MacAddressCleaner", "ScaleCleaner", "UrlCleaner"),
    "operators.frame": ("DataReader", "DataWriter"),
    "operators.naming": ("ColRenamer",),
    "operators.phone": ("PhoneCleaner",),
    "operators.text": ("EmailCleaner", "TextCleaner"),
    "operators.times": ("DateTimeCleaner",),
    "operators.values": ("BoolCleaner", "GenderCleaner", "NumericCleaner", "UuidCleaner"),
    "plans.clean": ("CleanConfig", "clean", "config", "plan"),
    "plans.pipeline": ("GroupCleaner", "Pipeline", "PipelineConfigError"),
}
_OF = {name: place for place, names in _PLACES.items() for name in names}
__all__ = sorted(_OF)


def __getattr__(name: str) -> object:
    if name not in _OF:
        raise AttributeError(f"module 'burnish' has no attribute {name!r}")
    return getattr(import_module(f"burnish.{_OF[name]}"), name)
