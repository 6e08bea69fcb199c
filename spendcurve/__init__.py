"""Customer-base analytics on Spark: from a transaction log to recency and frequency, churn models, value and cohorts."""

from spendcurve.operators.bootstrap import ParameterUncertainty
from spendcurve.operators.cohorts import CohortMatrix, CohortSurvival
from spendcurve.operators.customer_base import CustomerBase
from spendcurve.operators.independence import MonetaryIndependenceWarning, check_monetary_independence
from spendcurve.operators.lifetime_value import CLV
from spendcurve.operators.purchase_models import BGNBD, MBGNBD
from spendcurve.operators.spend_model import GammaGamma

__all__ = [
    "BGNBD", "CLV", "MBGNBD", "CohortMatrix", "CohortSurvival", "CustomerBase", "GammaGamma", "MonetaryIndependenceWarning", "ParameterUncertainty", "check_monetary_independence",
]
